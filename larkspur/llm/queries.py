"""The text operators' driver queries (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from .brown import op7_perplexity
from .chat import op2_chat
from .decontaminate import op5_decontamination
from .fingerprints import op1_fingerprint
from .html_text import op8_html
from .language import op9_language
from .mixing import ORACLE as MIXING_SQL
from .mixing import op6_mixing
from .neardup import ORACLE as NEARDUP_SQL
from .neardup import op4_neardup
from .credentials import ORACLE as SECRETS_SQL
from .credentials import op3_secrets
from .toxicity import op10_toxicity


def queries() -> dict:
    return {
        "op1_fingerprint": op1_fingerprint,
        "op2_chat": op2_chat,
        "op3_secrets": op3_secrets,
        "op4_neardup": op4_neardup,
        "op5_decontamination": op5_decontamination,
        "op6_mixing": op6_mixing,
        "op7_perplexity": op7_perplexity,
        "op8_html": op8_html,
        "op9_language": op9_language,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_secrets": SECRETS_SQL, "op4_neardup": NEARDUP_SQL, "op6_mixing": MIXING_SQL}
