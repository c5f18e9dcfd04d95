import pytest

from tracelake.operators import hybrid, mft
from tracelake.sources.testbed import MFT_HEADER


def cells(path, n="5", active="Active", kind="File", si="2024-01-05 10:00:00", mod="2024-01-05 10:00:00", fn="2024-01-05 10:00:00"):
    return [n, active, kind, path, si, mod, fn]


def records(spark, rows):
    return mft.records(spark.createDataFrame([(k + 1, r) for k, r in enumerate(rows)], "row_number long, cells array<string>"), list(MFT_HEADER))


def categories(spark, path, **k):
    return sorted(r["category"] for r in mft.findings(records(spark, [cells(path, **k)])).collect())


@pytest.mark.parametrize(
    ("path", "more", "want"),
    [
        ("\\Users\\a\\sliver.exe", {}, ["tool-sliver"]),
        ("\\docs\\a.pdf.exe", {}, ["double-extension"]),
        ("\\docs\\a.txt:hidden", {}, ["data-stream"]),
        ("\\docs\\a.txt:Zone.Identifier", {}, []),
        ("\\docs\\svchost.exe", {}, ["process-name"]),
        ("\\Windows\\Temp\\svchost.exe", {}, ["suspicious-place:windows-temp"]),
        ("\\run.bat", {}, ["suspicious-place:drive-root"]),
        ("\\Users\\a\\Desktop\\b.ps1", {"active": "Inactive"}, ["suspicious-place:desktop"]),
        ("\\tools\\b.exe", {"active": "Inactive"}, ["deleted-executable"]),
        ("\\Program Files\\b.exe", {"active": "Inactive"}, []),
        (".\\temp\\b.exe", {}, []),
        ("\\cache\\lib.dll\\b.exe", {"active": "Inactive"}, []),
        ("NoFNRecord", {}, []),
        ("", {}, []),
    ],
)
def test_rules(spark, path, more, want):
    assert categories(spark, path, **more) == want


def test_deleted_in_a_bad_place_is_worse(spark):
    rows = mft.findings(records(spark, [cells("\\Users\\a\\Desktop\\b.ps1", active="Inactive"), cells("\\Users\\a\\Desktop\\c.exe")])).orderBy("path").collect()
    assert [(r["severity"], r["technique_id"]) for r in rows] == [("high", "T1059.001"), ("medium", "T1105")]


def test_cells(spark):
    rows = records(spark, [cells("\\a\\B.TXT:s", n="0", si="45292.5", fn="zero"), cells("\\a\\.hidden", n="x", active="false", kind="Folder"), cells("zero", si="-")]).orderBy("path").collect()
    assert rows[0]["path"] == "" and rows[0]["si_created"] is None
    assert (rows[1]["record_number"], rows[1]["ext"], rows[1]["active"]) == (2, "", False)
    assert (rows[2]["record_number"], rows[2]["ext"], str(rows[2]["si_created"]), rows[2]["fn_created"]) == (1, "txt", "2024-01-01 12:00:00", None)


def test_headers():
    assert mft.is_mft_table(list(MFT_HEADER)) and mft.is_mft_table(["Inode", "Parent Path", "FileName"]) and not mft.is_mft_table(["time", "name"])
    assert mft.column_map(["EntryNumber", "InUse", "ParentPath", "FileName", "Created0x10"])["parent_path"] == 2


def test_totals_count_times_and_unnamed(spark):
    rows = records(spark, [cells("\\a\\x.txt", si="2024-01-01 00:00:00", fn="2024-01-03 00:00:00"), cells("\\a\\y.txt", si="2024-01-05 12:00:00"), cells("zero", kind="Folder")])
    t = mft.totals(rows).first()
    assert (t["records"], t["files"], t["folders"], t["si_before_fn"], t["si_after_change"]) == (3, 2, 1, 1, 1)


def test_risk_of_records(spark):
    rows = records(spark, [cells(f"\\data\\file{k}.txt", n=str(k + 10)) for k in range(20)] + [cells("\\Users\\a\\Downloads\\inv.pdf.exe", n="99", active="Inactive")])
    worst = hybrid.mft_anomalies(hybrid.mft_risk(rows)).first()
    assert worst["record_number"] == 99 and worst["score"] > 0.9
