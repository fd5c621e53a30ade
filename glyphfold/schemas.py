"""Declared schemas (no inference at read time)."""

from __future__ import annotations

# Tables of the test corpus.
TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}

# Positioned text.
ATOMS = (
    "doc_id bigint, page int, line_no int, tok_no int, text string, x double, y double, w double, h double, "
    "style_key string, mode int"
)
BOX_FIELDS = ("x", "y", "w", "h")

# Manifest of a document suite (DDL).
MANIFEST = (
    "schemaVersion int, suite int, pdf string, byteLength bigint, sha256 string, "
    "sizePolicy struct<minimumBytes:bigint,maximumBytes:bigint>, languages array<string>, "
    "fonts array<struct<inventoryName:string,reason:string,weight:int,italic:boolean>>, "
    "edits array<struct<language:string,pageIndex:int,sourceText:string,replacementText:string,"
    "fontInventoryName:string,verifyAfterReopen:boolean>>"
)
