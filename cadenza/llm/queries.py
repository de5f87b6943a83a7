"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

import corpus_pipeline

from .op1_pii import op1_pii
from .op10_suffix import op10_suffix
from .op2_dartminhash import op2_dartminhash
from .op3_bpe import op3_bpe
from .op4_rabitq import op4_rabitq
from .op5_extract import op5_extract
from .op6_language import op6_language
from .op7_packing import op7_packing
from .op8_multi_index import op8_multi_index
from .op9_secrets import op9_secrets
from .oracles import ORACLES

QUERIES = {f.__name__: f for f in (op1_pii, op2_dartminhash, op3_bpe, op4_rabitq, op5_extract, op6_language, op7_packing, op8_multi_index, op9_secrets, op10_suffix)}
QUERIES["pipeline"] = corpus_pipeline.run
