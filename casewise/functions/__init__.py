"""Column functions; every one returns a native Spark expression."""

from casewise.functions.dates import *  # noqa: F401,F403
from casewise.functions.json_cells import *  # noqa: F401,F403
from casewise.functions.levels import *  # noqa: F401,F403
from casewise.functions.numbers import *  # noqa: F401,F403
from casewise.functions.predicates import *  # noqa: F401,F403
from casewise.functions.text import *  # noqa: F401,F403
