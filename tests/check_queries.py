"""Run registered queries against their oracles: ``check_queries.py SF_DIR [name-prefix ..]``."""

import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from oracle import compare, connect  # noqa: E402

from pipeops.session import build_session, release  # noqa: E402

sf_dir, prefixes = sys.argv[1], tuple(sys.argv[2:])
spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.driver.memory": "16g", "spark.sql.warehouse.dir": "/tmp/pipeops-warehouse"})
spark.sparkContext.setLogLevel("OFF")
con, oracles, bad = connect(sf_dir), oracle_sql(), 0
for name, run in queries().items():
    if prefixes and not name.startswith(prefixes):
        continue
    began = time.time()
    try:
        df = run(spark, sf_dir)
        if name in oracles:
            problem = compare(df, con, oracles[name])
            verdict = "ok" if problem is None else f"DIFFERS {problem}"
        else:
            verdict = f"ok, no oracle, {df.count()} rows"
    except Exception as error:  # noqa: BLE001
        verdict = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        if "-v" in sys.argv:
            traceback.print_exc()
    bad += not verdict.startswith("ok")
    release(spark)
    if not verdict.startswith("ok") or "-q" not in sys.argv:
        print(f"{time.time() - began:6.2f}s {name}: {verdict[:900]}", flush=True)
print(f"{bad} bad of {len(queries())}")
