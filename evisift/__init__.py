"""Evidence-based screening and ranking of document collections on Spark.

Every operator takes and returns DataFrames, so each can be used on its own
with ``DataFrame.transform`` or through :func:`evisift.plans.screening.screen`.
"""

from evisift.params import ScreenParams
from evisift.vocabulary import Vocabulary

__all__ = ["ScreenParams", "Vocabulary"]
