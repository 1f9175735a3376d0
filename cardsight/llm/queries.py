"""Registers the queries of this subpackage (``common.QUERIES``, ``common.ORACLE``)."""

from . import (decontaminate, filteraudit, hamming, hmm, jaccardjoin, licenses, linededup, mixing, quality, secrets, suffixdedup,  # noqa: F401
               toxicity, whitening)
from .common import ORACLE, QUERIES  # noqa: F401
