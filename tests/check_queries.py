"""Command line: python tests/check_queries.py SF_DIR [name fragments]."""
import pathlib
import sys
import time
import traceback

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402
from settlegrid.session import build_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

if __name__ == "__main__":
    sf, parts = sys.argv[1], sys.argv[2:]
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="16g",
                          spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, texts, bad = connect(sf), entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            ok, message = compare(spark, name, fn, texts.get(name), sf, con)
        except Exception as e:
            ok, message = False, f"{type(e).__name__}: {str(e)[:1500]}"
            if parts:
                traceback.print_exc(limit=4)
        if not ok:
            bad.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {time.time() - t:6.2f}s {name}: {message}", flush=True)
    print("failed:", bad)
