"""Queries under a session built without strata's settings (another time
zone, ANSI off), as a caller might build it: run in a fresh process."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_plain_session_matches_oracle():
    env = dict(os.environ, PLAIN_SESSION="1", PLAIN_TZ="America/New_York", PLAIN_ANSI="false")
    keys = ["final_report", "running_share", "lognormal_ci", "validation_notice", "reversals_normalized", "run_date"]
    out = subprocess.run([sys.executable, os.path.join(ROOT, "tests", "oracle_check.py"), "/root/testdata/sf0.01", *keys],
                         env=env, capture_output=True, text=True, timeout=900)
    assert "FAILED: none" in out.stdout, out.stdout[-3000:] + out.stderr[-3000:]
