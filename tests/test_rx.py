from pyspark.sql import functions as F

from tracelake.rx import Rx, any_of
from tracelake.rules.signatures import SIGNATURES


def hit(spark, pattern, text, ignore_case=True):
    return spark.createDataFrame([(text,)], "t string").select(any_of(F.col("t"), (Rx(pattern, ignore_case),)).alias("x")).first()["x"]


def test_word_edges_are_ascii(spark):
    assert hit(spark, r"\badmin\b", "로그admin")
    assert not hit(spark, r"\badmin\b", "badmin")
    assert hit(spark, r"\badmin\b", "an admin.")


def test_end_is_the_end(spark):
    assert not hit(spark, "c$", "abc\n")
    assert hit(spark, "c$", "abc")
    assert hit(spark, r"a\$b[$]c", "a$b$c")


def test_case(spark):
    assert hit(spark, "AbC", "xabcx") and not hit(spark, "AbC", "xabcx", False)


def test_counts_of_rules():
    assert len(SIGNATURES) == 18 and sum(len(s.patterns) for s in SIGNATURES) == 94


def test_each_signature_hits_and_spares(spark):
    lines = {
        "recon-scanner": "agent Nikto/2", "recon-enum": "GET /wp-admin/x", "sqli": "id=1 UNION  SELECT 2", "xss": "<SCRIPT src=x>", "path-traversal": "..\\..\\x", "log4shell": "${jndi:dns://x}",
        "cmd-injection": "a; whoami", "brute-force": "Failed password for root", "cred-dump": "lsass.exe", "powershell-enc": "powershell -Enc xx", "webshell": "x.php?cmd=ls", "persistence-reg": "schtasks /create",
        "privesc": "sudo su", "log-clear": "wevtutil cl System", "lateral": "\\\\host\\ADMIN$", "c2-beacon": "/gate.php", "exfil": "scp a u@h", "ransomware": "vssadmin delete shadows",
    }
    df = spark.createDataFrame(list(lines.items()), "code string, t string")
    for s in SIGNATURES:
        found = [r["code"] for r in df.where(any_of(F.col("t"), s.patterns)).collect()]
        assert s.code in found
    plain = spark.createDataFrame([("GET /index.html 200 from 10.0.0.1",)], "t string")
    assert not any(plain.where(any_of(F.col("t"), s.patterns)).count() for s in SIGNATURES)


def test_rules_work_without_the_reader_of_patterns(spark, monkeypatch):
    """Guards then let every text through, and the same is found."""
    from tracelake import rx
    from tracelake.operators import iocs

    df = spark.createDataFrame([("see evil.example.com and 203.0.113.9 ../../etc/passwd",), ("nothing here",)], "t string")
    look = lambda: [sorted(map(str, r["f"])) for r in df.select(iocs.found(F.col("t"), F.lower("t")).alias("f")).collect()]
    with_reader = look()
    monkeypatch.setattr(rx, "_parser", None)
    rx.needed.cache_clear()
    try:
        assert rx.needed("nikto") == {""} and look() == with_reader and with_reader[0]
    finally:
        rx.needed.cache_clear()
