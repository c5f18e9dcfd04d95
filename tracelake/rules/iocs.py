"""Indicators of compromise in text."""

from __future__ import annotations

from tracelake.rx import Rx

# Kinds and patterns, in the order in which they are tried.
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
PATTERNS = (
    ("ip", Rx(IPV4, False)),
    ("hash-sha256", Rx(r"\b[a-fA-F0-9]{64}\b", False)),
    ("hash-sha1", Rx(r"\b[a-fA-F0-9]{40}\b", False)),
    ("hash-md5", Rx(r"\b[a-fA-F0-9]{32}\b", False)),
    ("cve", Rx(r"\bCVE-\d{4}-\d{4,7}\b")),
    ("email", Rx(r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", False)),
    ("url", Rx(r"\bhttps?://[^\s\"'<>]+")),
    ("domain", Rx(r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+(?:com|net|org|io|ru|cn|kr|info|biz|xyz|top|cc|tk|gq)\b")),
    ("filepath", Rx(r"\b[a-zA-Z]:\\(?:[^\\/:*?\"<>|\r\n]+\\)*[^\\/:*?\"<>|\r\n]+\.(?:exe|dll|ps1|bat|vbs|js|jar|sh|bin|scr)\b")),
)
PRIVATE = Rx(r"^(10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[0-1])\.|255\.|22[4-9]\.|23\d\.)", False)
STATIC_URL = Rx(r"\.(png|jpg|jpeg|gif|css|js|svg|ico|woff2?)(\?|#|$)")
SEVERITY = {"cve": "high", "hash-sha256": "medium", "hash-sha1": "medium", "hash-md5": "medium", "filepath": "medium"}
# Where a kind is looked up.
REFERENCE = {
    "ip": "https://www.virustotal.com/gui/ip-address/",
    "domain": "https://www.virustotal.com/gui/domain/",
    "hash-sha256": "https://www.virustotal.com/gui/file/",
    "hash-sha1": "https://www.virustotal.com/gui/file/",
    "hash-md5": "https://www.virustotal.com/gui/file/",
    "cve": "https://nvd.nist.gov/vuln/detail/",
}
REFERENCE_OTHER = "https://www.virustotal.com/gui/search/"
