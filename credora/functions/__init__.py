from credora.functions.ieee import (  # noqa: F401
    ieee_divide, ieee_log1p, ieee_sqrt, round_doubles, sigmoid,
)
from credora.functions.roles import column_roles  # noqa: F401
