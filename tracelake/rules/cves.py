"""Vulnerabilities that lines name or exploit."""

from __future__ import annotations

from dataclasses import dataclass

from tracelake.rx import Rx, c, i


@dataclass(frozen=True)
class Cve:
    id: str
    description: str
    cvss: float
    severity: str
    patterns: tuple[Rx, ...] = ()


# Ids, scores and patterns.
CVES = (
    Cve("CVE-2021-44228", "Log4j 2 runs code from a JNDI look-up (Log4Shell).", 10.0, "critical", i(r"\$\{jndi:", r"log4j")),
    Cve("CVE-2021-45046", "Log4j 2, the first fix was incomplete.", 9.0, "critical"),
    Cve("CVE-2017-9841", "PHPUnit runs PHP posted to eval-stdin.php.", 9.8, "critical", i(r"eval-stdin\.php", r"phpunit")),
    Cve("CVE-2014-6271", "Bash runs commands from variables (Shellshock).", 9.8, "critical", c(r"\(\)\s*\{\s*:;\s*\}") + i(r"shellshock")),
    Cve("CVE-2019-0708", "Remote Desktop runs code before log-in (BlueKeep).", 9.8, "critical", i(r"bluekeep", r"\bms_t120\b")),
    Cve("CVE-2020-1472", "Netlogon gives control of a domain controller (Zerologon).", 10.0, "critical", i(r"zerologon", r"netlogon")),
    Cve("CVE-2021-34527", "The Windows print spooler runs code (PrintNightmare).", 8.8, "high", i(r"printnightmare", r"spoolsv\.exe")),
)
#: What an id outside the table gets.
UNKNOWN = ("Not in the table.", 0.0, "medium")
