"""The queries of this subpackage and their SQL."""

from . import hard_negatives, license_scan, secret_scan, url_filter, vector_codes
from .decontaminate import op9_decontaminate
from .hard_negatives import op11_hard_negatives
from .license_scan import op12_license_scan
from .ngram_join import op2_ngram_join
from .packing import op3_packing
from .quality_classifier import op7_quality_classifier
from .quality_rules import op10_quality_rules
from .secret_scan import op8_secret_scan
from .sharding import op5_sharding
from .substring_dedup import op6_substring_dedup
from .toxicity import op1_toxicity
from .url_filter import op4_url_filter
from .vector_codes import op13_vector_codes

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_ngram_join, op3_packing, op4_url_filter, op5_sharding, op6_substring_dedup, op7_quality_classifier, op8_secret_scan, op9_decontaminate, op10_quality_rules, op11_hard_negatives, op12_license_scan, op13_vector_codes)}
#: The others have no SQL: models, shingles of whole texts, token ids and edit distances; their tests hold brute-force versions.
SQL: dict[str, str] = {"op4_url_filter": url_filter.oracle(), "op8_secret_scan": secret_scan.oracle(), "op11_hard_negatives": hard_negatives.ORACLE, "op12_license_scan": license_scan.oracle(), "op13_vector_codes": vector_codes.oracle()}
