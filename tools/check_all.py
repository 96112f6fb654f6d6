"""Run every registered job against its oracle: python tools/check_all.py [sf_dir] [name-substring]"""
import json
import re
import sys
import time

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from retailkit.catalog import queries, oracle_sql
from retailkit.check import compare, duck
from retailkit.session import build_session

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
pat = sys.argv[2] if len(sys.argv) > 2 else ""
spark = build_session()
con = duck(sf)
qs, os_ = queries(), oracle_sql()
bad = 0
for name, fn in qs.items():
    if pat and not re.search(pat, name):
        continue
    t = time.time()
    try:
        df = fn(spark, sf)
        if name in os_:
            r = compare(df, con, os_[name])
        else:
            r = {"spark_rows": df.count(), "match": None}
    except Exception as e:  # report and continue
        r = {"error": repr(e)[:600], "match": False}
    r["sec"] = round(time.time() - t, 2)
    if r.get("match") is False:
        bad += 1
    print(name, json.dumps(r, default=str), flush=True)
print("FAILED", bad)
