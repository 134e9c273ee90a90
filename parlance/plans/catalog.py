"""All registered queries (importing the modules fills the registry)."""

from . import q_dst  # noqa: F401
from . import q_tags  # noqa: F401
from . import q_corpus  # noqa: F401
from . import q_text  # noqa: F401
from . import q_dialogue  # noqa: F401
from . import q_dialogue_files  # noqa: F401
from . import q_vectors  # noqa: F401
from . import q_features  # noqa: F401
from . import q_sources  # noqa: F401
from . import q_dialogue_sets  # noqa: F401
from . import q_stream  # noqa: F401
from . import q_dialogue_fold  # noqa: F401  (oracles for the slot loop)
from .registry import REGISTRY  # noqa: F401
