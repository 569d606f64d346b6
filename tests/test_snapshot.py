import io
import zipfile

import pytest

from quartzfolio.errors import DataStop, ManifestError, SourceFormatError
from quartzfolio.sources import snapshot as S

FACTS = {"isin": "X1", "ter": "0.1", "income_policy": "Accumulating", "replication": "full", "fund_size": "EUR 2.00bn", "currency": "EUR"}
ARCHIVE = "This file was created by hand using the 202607 database\n\n,Mkt-RF,SMB\n202001, 1.00,-99.99\n202002,-99.99,-99.99\n202003, 2.50, 0.50\n\n Annual\n,Mkt-RF,SMB\n2020, 9.0, 9.0\n"


def zipped(text):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a.csv", text)
    return data.getvalue()


@pytest.fixture
def root(tmp_path):
    home = tmp_path / "2026-09-13"
    (home / "prices").mkdir(parents=True)
    (home / "prices" / "AAA.csv").write_text("date,close,adj_close,dividend\n2020-01-01,10,10,0\n2020-02-01,11,11,\n")
    (home / "rate.csv").write_text("KEY,TIME_PERIOD,OBS_VALUE\nk,2020-01-01,1.0\nk,2020-01-01,9.0\nk,2020-01-02,2.0\n")
    (home / "f.zip").write_bytes(zipped(ARCHIVE))
    return home


def entries():
    base = {"source": "s", "url": "u", "retrieved": "2026-09-13"}
    return [base | {"path": "prices/AAA.csv", "role": "price", "instrument": "AAA", "currency": "EUR"}, base | {"path": "rate.csv", "role": "rate"}, base | {"path": "f.zip", "role": "factor"}]


def test_archive_rules():
    rows, vintage = S.parse_archive(zipped(ARCHIVE))
    assert rows == [("2020-01-01", "Mkt-RF", 0.01), ("2020-01-01", "SMB", None), ("2020-03-01", "Mkt-RF", 0.025), ("2020-03-01", "SMB", 0.005)]
    assert vintage == "202607"
    with pytest.raises(SourceFormatError):
        S.parse_archive(b"no zip")


def test_build_verify_and_tampering(spark, root):
    S.build_manifest(spark, root, entries(), {"AAA": FACTS}, "2026-09-13")
    m = S.verify(spark, root)
    assert {e["path"]: (e["rows"], e["first"], e["last"]) for e in m["files"]} == {"prices/AAA.csv": (2, "2020-01-01", "2020-02-01"), "rate.csv": (3, "2020-01-01", "2020-01-02"), "f.zip": (2, "2020-01", "2020-03")}
    rows = S.read_prices(spark, root, [m["files"][0]]).orderBy("period_month").collect()
    assert [(r.instrument, r.dividend, str(r.available_from)) for r in rows] == [("AAA", 0.0, "2020-02-01"), ("AAA", 0.0, "2020-03-01")]
    assert [r.pct for r in S.read_rates(spark, str(root / "rate.csv")).orderBy("day").collect()] == [1.0, 2.0]
    (root / "rate.csv").write_text("KEY,TIME_PERIOD,OBS_VALUE\nk,2020-01-01,1.5\n")
    with pytest.raises(ManifestError):
        S.verify(spark, root)


def test_refusals(spark, root, tmp_path):
    with pytest.raises(ManifestError):
        S.read_manifest(root)
    with pytest.raises(DataStop):
        S.read_prices(spark, root, [])
    S.build_manifest(spark, root, entries(), {"AAA": FACTS | {"isin": ""}}, "2026-09-13")
    with pytest.raises(DataStop):
        S.verify(spark, root)
    assert S.snapshot_root(str(tmp_path)) == root


def test_two_files_of_one_name(spark, root):
    """Files are known by their path under the snapshot, not by their last name."""
    (root / "fx").mkdir()
    (root / "fx" / "AAA.csv").write_text("date,close,adj_close,dividend\n2019-01-01,1.1,1.1,0\n2019-02-01,1.2,1.2,0\n2019-03-01,1.3,1.3,0\n")
    files = [*entries(), entries()[0] | {"path": "fx/AAA.csv", "role": "fx", "instrument": "EURUSD", "currency": "USD"}]
    S.build_manifest(spark, root, files, {"AAA": FACTS}, "2026-09-13")
    m = S.verify(spark, root)
    assert {e["path"]: (e["rows"], e["first"]) for e in m["files"] if "AAA" in e["path"]} == {"prices/AAA.csv": (2, "2020-01-01"), "fx/AAA.csv": (3, "2019-01-01")}
    rows = S.read_prices(spark, root, [e for e in m["files"] if e["role"] in ("price", "fx")]).collect()
    assert sorted((r.instrument, r.close) for r in rows) == [("AAA", 10.0), ("AAA", 11.0), ("EURUSD", 1.1), ("EURUSD", 1.2), ("EURUSD", 1.3)]
    text = (root / "fx" / "AAA.csv").read_text()
    (root / "fx" / "AAA.csv").write_text((root / "prices" / "AAA.csv").read_text())
    (root / "prices" / "AAA.csv").write_text(text)
    with pytest.raises(ManifestError, match="hash differs"):
        S.verify(spark, root)


def test_a_file_without_dates_is_measured(spark, root):
    (root / "rate.csv").write_text("KEY,TIME_PERIOD,OBS_VALUE\n")
    got = {r.path: (r.rows, r["first"]) for r in S.measure(spark, root, entries()).collect()}
    assert got["rate.csv"] == (0, None) and got["prices/AAA.csv"] == (2, "2020-01-01")


def test_cells_that_are_no_numbers():
    for row in ("202001, 1.00,", "202001, 1.00, x", "202001, 1.00"):
        with pytest.raises(SourceFormatError, match="202001"):
            S.parse_archive(zipped(f"created by hand\n\n,Mkt-RF,SMB\n{row}\n"))
