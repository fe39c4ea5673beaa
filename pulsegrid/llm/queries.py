"""The queries of this subpackage: name -> function of (spark, sf_dir), and SQL for those that SQL can express."""

from .bpe_codec import op11_bpe_codec
from .decontamination import OP9_SQL, op9_decontamination
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .language_id import op1_language_id
from .license_scan import op6_license_scan
from .mixing import op5_mix_sources
from .ngram_join import op3_ngram_join
from .resampling import op13_resampling
from .secrets import op2_secret_scan
from .token_counts import op8_token_counts
from .toxicity import op10_toxicity
from .url_filters import OP7_SQL, op7_url_filter
from .whitening import op12_whitening

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_secret_scan": op2_secret_scan,
    "op3_ngram_join": op3_ngram_join,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_mix_sources": op5_mix_sources,
    "op6_license_scan": op6_license_scan,
    "op7_url_filter": op7_url_filter,
    "op8_token_counts": op8_token_counts,
    "op9_decontamination": op9_decontamination,
    "op10_toxicity": op10_toxicity,
    "op11_bpe_codec": op11_bpe_codec,
    "op12_whitening": op12_whitening,
    "op13_resampling": op13_resampling,
}

SQL = {
    "op4_exact_dedup": OP4_SQL,
    "op7_url_filter": OP7_SQL,
    "op9_decontamination": OP9_SQL,
}
