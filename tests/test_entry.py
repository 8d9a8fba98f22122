import importlib.util
import os
import re

import pytest

SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 90


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10


def test_nothing_else_imports_the_pipeline_operators():
    root = os.path.dirname(importlib.util.find_spec("embervane").origin)
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n)) as f:
                    assert not re.search(r"\bllm\b", f.read()), n
