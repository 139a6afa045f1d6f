"""Registered queries against their SQL at the smallest size."""

import math

import duckdb
import pytest

from inkwarden.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()
#: Run in every test run; the driver compares all of them.
QUICK = (
    "a01_queue a04_validation a07_pdf b01_email_spans b04_case_id_spans b07_date_exact_spans b12_location_spans b14_person_spans c03_name_scores c04_phonetic c07_name_tokens c08_name_spans d03_dates d04_valid_dates d10_mrz "
    "d12_passport_checks e01_document_types e03_invalid_passports f01_letters f03_generalised_dates f04_anonymized f05_softened g03_item_hits g04_item_bars g07_undo g08_finalised h01_scripts h06_overlaps h07_merge "
    "h10_page_confidence i01_upscaled i02_gray i03_equalised i04_blurred i05_unsharp i06_thresholds i07_binarised i08_deskewed i09_stretched i11_plumbing j03_session j08_file_sizes flagship_redaction"
).split()


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_same_rows(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    want = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 60
