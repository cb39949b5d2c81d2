"""The registry of metrics: rung, default band and how a corpus calibrates it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: metric | rung | lo | hi | calibration (p99, band, policy, rate)
_ROWS = """
cognitive|2||15|p99
cyclomatic|2||10|p99
depth|2||4|p99
length|2||60|p99
params|2||5|p99
flag params|3||0|policy
expr depth|1||10|p99
demeter|1||0|p99
negations|1||0|policy
live span|2||40|p99
magic numbers|0||3|p99
spooky|3||0|policy
pass-through|4||0|policy
kw opacity|3||0|policy
and name|4||0|policy
generic name|3||0|policy
feature envy|4||0|policy
swallowed|2||0|policy
broad catch|3||0|policy
unwraps|3||2|policy
lying name|3||0|policy
test asserts|3|1||policy
asserts|5|||rate
public docs|5|||rate
echo comments|3||0|policy
comment ratio|3|0.02|0.6|band
untyped params|3||0|p99
loose types|3||0|p99
casts|3||0|p99
suppressions|3||0|policy
confusable|3||2|p99
terse name|3||0|p99
abbreviated|0||0|p99
vacuous asserts|3||0|policy
lost context|3||0|policy
secrets|0||0|policy
blocking async|2||0|policy
dropped tasks|3||0|p99
wildcard match|3||0|p99
stringly id|3||0|p99
loop depth|3||2|p99
alloc in loop|3||0|p99
conditional hook|2||0|policy
returns|3||3|p99
interface width|3||12|p99
repurposed|3||0|p99
unawaited coroutine|3||0|policy
magic strings|4||0|p99
sleepy test|3||0|p99
skipped tests|3||0|p99
bool traps|3||0|p99
commented code|3||0|p99
cohesion|4||5|p99
built query|2||0|policy
shelled out|2||0|policy
ceremony|3||0|policy
module doc|3||170|p99
type doc|3||130|p99
fn doc|3||140|p99
field doc|3||90|p99
inline doc|3||80|p99
doc param|3||0|policy
"""


def rows() -> list[tuple[str, int, float | None, float | None, str]]:
    out = []
    for line in _ROWS.split("\n"):
        if line:
            metric, rung, lo, hi, calib = line.split("|")
            out.append((metric, int(rung), float(lo) if lo else None, float(hi) if hi else None, calib))
    return out


def metrics(spark: SparkSession) -> DataFrame:
    """(metric, rung, lo, hi, calib): 62 rows."""
    return spark.createDataFrame(rows(), "metric string, rung int, lo double, hi double, calib string")
