import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from wavelark.session import local

    warehouse = tmp_path_factory.mktemp("warehouse")
    return local(8, **{"spark.sql.shuffle.partitions": "8", "spark.sql.warehouse.dir": str(warehouse)})
