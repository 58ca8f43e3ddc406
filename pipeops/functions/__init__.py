from .expressions import as_column, key_struct, named_column, sort_directions, sort_key, sort_keys
from .predicates import predicate
from .quantiles import exact_quantiles

__all__ = [
    "as_column",
    "exact_quantiles",
    "key_struct",
    "named_column",
    "predicate",
    "sort_directions",
    "sort_key",
    "sort_keys",
]
