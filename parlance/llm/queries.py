"""All registered queries of this subpackage (importing the modules fills the registry)."""

from . import q_quality  # noqa: F401
from . import q_shards  # noqa: F401
from . import q_simhash  # noqa: F401
from . import q_tokens  # noqa: F401
from . import q_packed  # noqa: F401
from . import q_decontam  # noqa: F401
from . import q_pieces  # noqa: F401
from . import q_toxicity  # noqa: F401
from . import q_langid  # noqa: F401
from . import q_lm  # noqa: F401
from . import q_runs  # noqa: F401
from . import q_divergence  # noqa: F401
from . import q_bpe  # noqa: F401
from .registry import LLM_QUERIES  # noqa: F401
