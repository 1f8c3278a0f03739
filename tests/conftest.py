import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from actarium.config import DetectionConfig  # noqa: E402
from actarium.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def cfg():
    return DetectionConfig(
        target="Aurora", tax_ids=("11.222.333/0001-81", "44.555.666/0001-77"), postal_prefixes=("87670",), neighbours=("Florai", "Cruzeiro do Sul", "Colorado"),
        scan_variants=(r"AU\s*RO\s*RA",), truncated_stem="AU", named_persons=("joao silva",))
