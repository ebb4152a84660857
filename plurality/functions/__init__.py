"""Column builders. Everything here stays inside the JVM and whole-stage codegen."""

from .distribution import *  # noqa: F401,F403
from .hashing import *  # noqa: F401,F403
