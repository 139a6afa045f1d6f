"""Times the headline document queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from inkwarden.plans import registry
from inkwarden.session import local_session

HEADLINE = ["flagship_redaction", "b03_refcom_spans", "b12_location_spans", "b14_person_spans", "c08_name_spans", "d03_dates", "d10_mrz", "d14_fields", "e01_document_types", "f02_placeholders", "g05_bars", "h06_overlaps", "h07_merge", "j03_session"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, 2 * int(cpus), "12g")
    found, took = registry.queries(), {}
    for name in HEADLINE:
        began = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf_dir.rstrip("/").rsplit("sf", 1)[-1]) if "sf" in sf_dir else None}))


if __name__ == "__main__":
    main()
