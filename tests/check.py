"""Command line check: python tests/check.py FOLDER [name-prefix ...]"""

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])

import __spark_entry__ as entry  # noqa: E402
from doclattice.session import local_session  # noqa: E402
from tests.compare import connect, differences  # noqa: E402

folder, prefixes = sys.argv[1], tuple(a for a in sys.argv[2:] if a[0] != '-') or ("",)
spark = local_session()
spark.sparkContext.setLogLevel("ERROR")
con = connect(folder)
oracles = entry.oracle_sql()
good = bad = 0
for name, fn in entry.queries().items():
    if not name.startswith(prefixes):
        continue
    t = time.time()
    try:
        df = fn(spark, folder)
        n = df.toArrow().num_rows
        st = time.time() - t
        if "--time" in sys.argv:
            diff = [] if n else ["no rows at all"]
        else:
            diff = differences(df, con, oracles[name]) if name in oracles else (
                [] if n else ["no rows at all"])
    except Exception as e:  # report and go on with the next query
        diff = [f"{type(e).__name__}: {str(e)[:1500]}"]
    dt = time.time() - t
    if diff:
        bad += 1
        print(f"BAD  {name} {dt:.1f}s", *diff, sep="\n     ", flush=True)
    else:
        good += 1
        print(f"ok   {name} spark {st:.1f}s all {dt:.1f}s{'' if name in oracles else ' (rows only)'}", flush=True)
print(f"{good} good, {bad} bad")
