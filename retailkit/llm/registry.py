"""Queries of this package: name -> callable(spark, sf_dir), and SQL twins where SQL can express them."""

from __future__ import annotations

from retailkit.llm.bpe import op9_bpe
from retailkit.llm.chat_format import op6_chat_format
from retailkit.llm.filter_audit import OP12_SQL, op12_filter_audit
from retailkit.llm.fingerprints import op4_fingerprints
from retailkit.llm.id_store import op11_id_store
from retailkit.llm.licenses import op8_licenses
from retailkit.llm.near_dup import op10_near_dup
from retailkit.llm.packing import op3_packing
from retailkit.llm.quality import op7_quality_rules
from retailkit.llm.secret_scan import op2_secret_scan
from retailkit.llm.sharding import OP5_SQL, op5_sharding
from retailkit.llm.spelling import op13_spelling
from retailkit.llm.url_filter import op1_url_filter

QUERIES = {f.__name__: f for f in (op1_url_filter, op2_secret_scan, op3_packing, op4_fingerprints, op5_sharding, op6_chat_format,
                                   op7_quality_rules, op8_licenses, op9_bpe, op10_near_dup, op11_id_store, op12_filter_audit, op13_spelling)}
SQL: dict[str, str] = {"op5_sharding": OP5_SQL, "op12_filter_audit": OP12_SQL}
