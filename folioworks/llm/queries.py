"""The queries of this subpackage and the SQL of those that SQL can express."""

from .binary import op8_binary
from .chat import OP9_SQL, op9_chat
from .collocations import OP11_SQL, op11_collocations
from .decontam import op10_decontamination
from .fingerprints import op2_fingerprints
from .language import op7_language
from .minhash import op1_minhash
from .negatives import OP12_SQL, op12_negatives
from .packing import op5_packing
from .quality import op6_quality
from .reshard import op4_reshard
from .secret_scan import OP13_SQL, op13_secrets
from .urls import op3_urls


def queries() -> dict:
    found = (op1_minhash, op2_fingerprints, op3_urls, op4_reshard, op5_packing, op6_quality, op7_language, op8_binary, op9_chat, op10_decontamination, op11_collocations, op12_negatives, op13_secrets)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op9_chat": OP9_SQL, "op11_collocations": OP11_SQL, "op12_negatives": OP12_SQL, "op13_secrets": OP13_SQL}
