"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from .chat import OP7_SQL, op7_chat_format
from .imatch import op6_imatch
from .jaccard import op1_jaccard_join
from .lines import OP9_SQL, op9_line_dedup
from .media import op2_flac_media
from .mixing import op8_source_mix
from .packing import op10_best_fit_packing
from .perplexity import op5_quality_perplexity
from .repeats import op11_suffix_dedup
from .secrets import op4_secret_scan
from .spelling import op13_spelling_variants
from .toxicity import op3_toxicity
from .tries import OP12_SQL, op12_prefix_trie

QUERIES = {f.__name__: f for f in (op1_jaccard_join, op2_flac_media, op3_toxicity, op4_secret_scan, op5_quality_perplexity, op6_imatch, op7_chat_format, op8_source_mix, op9_line_dedup, op10_best_fit_packing, op11_suffix_dedup, op12_prefix_trie, op13_spelling_variants)}
SQL = {"op7_chat_format": OP7_SQL, "op9_line_dedup": OP9_SQL, "op12_prefix_trie": OP12_SQL}
