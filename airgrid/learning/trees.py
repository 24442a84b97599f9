"""The tree ensembles by name; ``forest`` and ``boosting`` grow them."""

from airgrid.learning.boosting import AdaBoost, AdaBoostModel, BoostedModel, BoostedTrees  # noqa: F401
from airgrid.learning.forest import ExtraTrees, ExtraTreesModel, RandomForest, RandomForestModel  # noqa: F401
