"""Operators on executors that do not have this package: functions travel by value, with all they use."""

import pathlib
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parents[2]
SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as driver
from tidelog import build_session
spark = build_session("workers", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.sql.warehouse.dir": sys.argv[1]}})


def lacks(batches):
    import importlib.util

    for b in batches:
        assert importlib.util.find_spec("tidelog") is None
        yield b


assert spark.range(3).mapInArrow(lacks, "id long").count() == 3
plans = driver.queries()
for name in sys.argv[2:]:
    assert plans[name](spark, "/root/testdata/sf0.001").count() > 0, name
    print("ran", name)
"""
NAMES = [
    "op3_quality_rules", "op5_token_counts", "op7_sampled_segmentation", "op8_language_id", "op9_main_text", "op11_byte_bpe",
    "op12_phrase_collocations", "op13_fill_in_middle", "stream_retry",
]


def test_workers_need_no_package(tmp_path):
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path / "w"), *NAMES], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert [x.split()[1] for x in done.stdout.splitlines() if x.startswith("ran ")] == NAMES, done.stderr[-3000:]
