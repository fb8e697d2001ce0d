"""sumwell: regression from sufficient statistics, computed with Spark aggregations.

A DataFrame is reduced by ordinary aggregations to what a model needs, and the
small problem that remains is solved on the driver.  Every estimate equals the
one on the uncompressed rows.
"""

from sumwell.functions.solve import ridge_closed_form, ridge_closed_form_batch, wls
from sumwell.operators.base import Estimator
from sumwell.operators.bitmap import BitmapEventStudy, BitmapMundlak, BitmapPanel, BitPacker, demo_panel, one_shot_panel, pack_long_panel, staggered_panel, translation_table
from sumwell.operators.dml import PartialOut
from sumwell.operators.eventstudy import EventStudy
from sumwell.operators.glm import LabelPoisson, LogisticRegression, MultinomialLogit, PoissonRegression
from sumwell.operators.linear import LinearRegression
from sumwell.operators.panel import DoubleDemeaning, Mundlak
from sumwell.operators.ridge import Ridge

__all__ = [
    "BitPacker", "BitmapEventStudy", "BitmapMundlak", "BitmapPanel", "DoubleDemeaning", "Estimator", "EventStudy", "LabelPoisson", "LinearRegression", "LogisticRegression", "MultinomialLogit", "Mundlak", "PartialOut", "PoissonRegression", "Ridge",
    "demo_panel", "one_shot_panel", "pack_long_panel", "ridge_closed_form", "ridge_closed_form_batch", "staggered_panel", "translation_table", "wls",
]
