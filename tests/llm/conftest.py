import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(autouse=True, scope="module")
def no_tokenizers_of_other_files():
    """Encoders that the tests of a file leave in the test process do not count in the next file."""
    yield
    if segments := sys.modules.get("leadlane.llm.segments"):
        segments.encoder.cache_clear()
