"""Between the jobs of a query the driver collects what past ones left, once its heap has grown."""

from types import SimpleNamespace

import pytest

from velograph.plans import materialize


@pytest.mark.parametrize(("master", "held", "times"), [("spark://one:7077", 600, 1), ("spark://one:7077", 300, 0), ("local-cluster[3,2,3000]", 600, 1), ("local[4]", 600, 0), ("local", 600, 0)])
def test_heap_is_collected_once_it_has_grown(master, held, times):
    done = []
    heap = SimpleNamespace(totalMemory=lambda: held, maxMemory=lambda: 750)
    java = SimpleNamespace(lang=SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: heap)))
    jvm = SimpleNamespace(java=java, System=SimpleNamespace(gc=lambda: done.append(1)))
    materialize._let_go(SimpleNamespace(sparkContext=SimpleNamespace(master=master), _jvm=jvm))
    assert len(done) == times
