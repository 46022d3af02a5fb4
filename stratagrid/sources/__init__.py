"""Readers and writers of cubes."""

from .polygons import read_polygons  # noqa: F401
from .readers import *  # noqa: F403
from .writers import *  # noqa: F403
