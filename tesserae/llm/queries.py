"""The queries of this subpackage and their SQL."""

from tesserae.llm import mixing, secrets
from tesserae.llm.jaccard import op6_ngram_jaccard_join
from tesserae.llm.lines import op1_line_dedup
from tesserae.llm.metric_join import op9_embedding_near_dedup
from tesserae.llm.mixing import op7_mixing
from tesserae.llm.quality import op8_quality_rules
from tesserae.llm.secrets import op10_secret_scans
from tesserae.llm.sharding import op4_hilbert_sharding
from tesserae.llm.spm import op5_sentencepiece
from tesserae.llm.toxicity import op2_toxicity
from tesserae.llm.warc import op3_warc

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_warc": op3_warc,
    "op4_hilbert_sharding": op4_hilbert_sharding,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_mixing": op7_mixing,
    "op8_quality_rules": op8_quality_rules,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_secret_scans": op10_secret_scans,
}
ORACLES: dict[str, str] = {"op7_mixing": mixing.ORACLE, "op10_secret_scans": secrets.ORACLE}
