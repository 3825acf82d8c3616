"""Table operators; importing the package registers every replayable step."""

from millrace.operators import create, encode, missing, outliers, scale, transform  # noqa: F401
