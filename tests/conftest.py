import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ramify.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session(8)


@pytest.fixture(scope="session")
def image(spark):
    """One 40 x 60 image."""
    return spark.createDataFrame([(1, "a", "wt-day3", 40, 60, 20)],
                                 "image_id long, image string, genotype string, length_px int, width_px int, cellbody_px int")
