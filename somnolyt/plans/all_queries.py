"""Import every catalog module so the registry is complete."""

from . import catalog  # noqa: F401
from . import catalog_profile  # noqa: F401
from . import catalog_matrix  # noqa: F401
from . import catalog_eval  # noqa: F401
from . import catalog_knn  # noqa: F401
from . import catalog_models  # noqa: F401
from . import catalog_stats  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
