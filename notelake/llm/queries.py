"""The registered queries of this subpackage, and their SQL where SQL can express one."""

from notelake.llm.alignment import op11_tokenizer_alignment
from notelake.llm.bpe import op7_byte_bpe
from notelake.llm.decontaminate import op10_decontamination
from notelake.llm.html_text import op5_html_text
from notelake.llm.licenses import op13_license_scan
from notelake.llm.lines import OP2_SQL, op2_line_dedup
from notelake.llm.manifest import OP12_SQL, op12_merkle_manifest
from notelake.llm.pii import op9_personal_data
from notelake.llm.quality import op4_quality_rules
from notelake.llm.secrets import op3_secret_scan
from notelake.llm.sharding import op6_sharding
from notelake.llm.simhash import op8_simhash_near_dedup
from notelake.llm.urls import op1_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_line_dedup, op3_secret_scan, op4_quality_rules, op5_html_text, op6_sharding, op7_byte_bpe, op8_simhash_near_dedup, op9_personal_data, op10_decontamination,
        op11_tokenizer_alignment, op12_merkle_manifest, op13_license_scan,
    )
}
ORACLE_SQL = {"op2_line_dedup": OP2_SQL, "op12_merkle_manifest": OP12_SQL}
