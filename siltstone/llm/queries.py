"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .ann import op8_nearest
from .decontam import OP6_SQL, op6_decontamination
from .langid import op4_language
from .licenses import OP3_SQL, op3_licenses
from .negatives import OP11_SQL, op11_hard_negatives
from .packing import op9_packing
from .pii import op7_pii
from .quality import op1_quality
from .secretscan import op10_secrets
from .simhash import op2_simhash
from .spelling import OP13_SQL, op13_variants
from .topk import OP12_SQL, op12_top_products
from .urlfilter import op5_url_filter

QUERIES = {
    "op1_quality": op1_quality,
    "op2_simhash": op2_simhash,
    "op3_licenses": op3_licenses,
    "op4_language": op4_language,
    "op5_url_filter": op5_url_filter,
    "op6_decontamination": op6_decontamination,
    "op7_pii": op7_pii,
    "op8_nearest": op8_nearest,
    "op9_packing": op9_packing,
    "op10_secrets": op10_secrets,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_top_products": op12_top_products,
    "op13_variants": op13_variants,
}

ORACLE_SQL: dict[str, str] = {"op3_licenses": OP3_SQL, "op6_decontamination": OP6_SQL, "op11_hard_negatives": OP11_SQL, "op12_top_products": OP12_SQL, "op13_variants": OP13_SQL}
