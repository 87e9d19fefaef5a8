import re
import sys
from pathlib import Path

import pytest

from tesserae.llm import common


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_intermediate_tables_give_back_what_the_drivers_jvm_has_freed(spark):
    jvm = spark.sparkContext._jvm
    if not common.trim_driver(spark):
        pytest.skip("this JVM has no such command")
    maps = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps")

    def held_mb() -> float:
        """Memory outside the heap, which lies in low addresses."""
        return sum(int(kb) for at, kb in re.findall(r"^([0-9a-f]+)-[0-9a-f]+ .*?^Anonymous:\s+(\d+)", maps.read_text(), re.M | re.S) if int(at, 16) >> 40) / 1024

    made = [jvm.java.util.zip.Deflater() for _ in range(4000)]  # some 0.08 MB each outside the heap
    for i, x in enumerate(made):
        if i % 10:  # those that stay keep the allocator from giving the others back by itself
            x.end()
    before = held_mb()
    for _ in range(common.TRIM_EVERY):
        common.materialize(spark.range(3), "test")
    after = held_mb()
    for x in made[::10]:
        x.end()
    assert after < before - 100
