import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from martlib.session import get_spark

    session = get_spark(
        "tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.driver.host": "127.0.0.1"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def rows(df, *columns):
    """Sorted tuples."""
    out = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in out.collect()), key=lambda t: tuple((x is not None, str(type(x)) if isinstance(x, (dict, list)) else "", x if x is not None else 0) for x in t))


def plan_nodes(spark, run):
    """(name, metrics by name) of the nodes in the plans of all that run() executes."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    listed = lambda seq: [seq.apply(i) for i in range(seq.size())]
    bus.waitUntilEmpty()
    before = {e.executionId() for e in listed(store.executionsList())}
    run()
    bus.waitUntilEmpty()
    out = []
    for e in listed(store.executionsList()):
        if e.executionId() not in before:
            values = store.executionMetrics(e.executionId())
            for node in listed(store.planGraph(e.executionId()).allNodes()):
                metrics = {m.name(): values.get(m.accumulatorId()) for m in listed(node.metrics())}
                out.append((node.name(), {k: v.get() for k, v in metrics.items() if v.isDefined()}))
    return out
