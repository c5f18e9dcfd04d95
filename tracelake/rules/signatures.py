"""Signatures of log lines, and the tactics and techniques they map to."""

from __future__ import annotations

from dataclasses import dataclass

from tracelake.rx import Rx, c, i


@dataclass(frozen=True)
class Signature:
    code: str
    description: str
    patterns: tuple[Rx, ...]
    technique: str
    name: str
    tactic: str
    severity: str
    cves: tuple[str, ...] = ()


# Tactic ids, names and their order along an intrusion.
TACTICS = {
    "TA0043": ("Reconnaissance", 1),
    "TA0001": ("Initial Access", 2),
    "TA0002": ("Execution", 3),
    "TA0003": ("Persistence", 4),
    "TA0004": ("Privilege Escalation", 5),
    "TA0005": ("Defense Evasion", 6),
    "TA0006": ("Credential Access", 7),
    "TA0007": ("Discovery", 8),
    "TA0008": ("Lateral Movement", 9),
    "TA0009": ("Collection", 10),
    "TA0011": ("Command and Control", 11),
    "TA0010": ("Exfiltration", 12),
    "TA0040": ("Impact", 13),
}

# Codes, patterns, techniques, severities and CVE links of the signatures.
SIGNATURES = (
    Signature("recon-scanner", "A known scanner's name or agent string.", i(r"sqlmap", r"nikto", r"nmap", r"masscan", r"dirbuster", r"gobuster", r"wpscan", r"acunetix", r"nessus", r"\bzgrab\b"), "T1595", "Active Scanning", "TA0043", "medium"),
    Signature("recon-enum", "A request for an administration path or a sensitive file.", i(r"/(admin|wp-admin|phpmyadmin|\.git|\.env|backup|config)\b", r"/(login|administrator)/?\s"), "T1595.003", "Wordlist Scanning", "TA0043", "low"),
    Signature("sqli", "SQL syntax where none belongs.", i(r"union\s+select", r"'\s*or\s*'?1'?\s*=\s*'?1", r"\b(select|insert|update|delete)\b.+\bfrom\b", r"information_schema", r"sleep\(\d+\)", r"benchmark\(") + c(r"--\s|;--"), "T1190", "Exploit Public-Facing Application", "TA0001", "high", ("CVE-2017-9841",)),
    Signature("xss", "Script in a request parameter.", i(r"<script\b", r"onerror\s*=", r"onload\s*=", r"javascript:", r"document\.cookie", r"%3cscript"), "T1059.007", "JavaScript", "TA0002", "medium"),
    Signature("path-traversal", "A climb out of the document root, or a system file.", c(r"\.\.[\\/]\.\.") + i(r"/etc/passwd", r"/etc/shadow", r"boot\.ini", r"win\.ini", r"%2e%2e%2f", r"\.\.%2f"), "T1083", "File and Directory Discovery", "TA0007", "high"),
    Signature("log4shell", "A JNDI look-up in logged input.", i(r"\$\{jndi:(ldap|ldaps|rmi|dns|nis|iiop|corba|nds|http)", r"\$\{.*lower:.*j.*n.*d.*i"), "T1190", "Exploit Public-Facing Application", "TA0001", "critical", ("CVE-2021-44228", "CVE-2021-45046")),
    Signature("cmd-injection", "A shell command behind a separator.", i(r";\s*(cat|whoami|id|uname|wget|curl|nc|bash|sh)\b", r"\|\s*(whoami|id|nc|bash)\b") + c(r"\$\(.*\)", r"`[^`]+`") + i(r"&&\s*(curl|wget)\b"), "T1059", "Command and Scripting Interpreter", "TA0002", "high"),
    Signature("brute-force", "A failed authentication.", i(r"failed\s+(password|login|logon)", r"authentication\s+fail", r"invalid\s+(user|credentials|password)", r"login\s+failed", r"\b(401|403)\b.*/(login|signin|auth|admin)", r"로그인\s*실패", r"event\s*id[:=\s]*4625"), "T1110", "Brute Force", "TA0006", "high"),
    Signature("cred-dump", "A tool or a file of credential dumping.", i(r"mimikatz", r"lsass\.exe", r"sekurlsa", r"\bsamdump\b", r"reg\s+save\s+hklm\\sam", r"procdump.*lsass"), "T1003", "OS Credential Dumping", "TA0006", "critical"),
    Signature("powershell-enc", "PowerShell with hidden or encoded commands.", i(r"powershell.*-enc(odedcommand)?\b", r"powershell.*-nop(rofile)?\b.*-w(indowstyle)?\s+hidden", r"iex\s*\(", r"downloadstring", r"frombase64string"), "T1059.001", "PowerShell", "TA0002", "high"),
    Signature("webshell", "A script that runs what a request says.", i(r"(eval|system|exec|passthru|shell_exec|assert)\s*\(\s*\$?_(GET|POST|REQUEST)", r"cmd\.(jsp|aspx?)", r"c99|r57|wso\s*shell", r"\.(php|jsp|aspx?)\?(cmd|exec)="), "T1505.003", "Web Shell", "TA0003", "critical"),
    Signature("persistence-reg", "An entry in an autostart place.", i(r"reg\s+add.*\\(current)?version\\run", r"schtasks\s+/create", r"new-scheduledtask", r"\\startup\\"), "T1547.001", "Registry Run Keys / Startup Folder", "TA0003", "high"),
    Signature("privesc", "A step to higher rights.", i(r"\bsudo\s+(su|-i|bash)", r"runas\s+/user:administrator", r"getsystem", r"\bsedebugprivilege\b", r"\b(privilege escalat)"), "T1068", "Exploitation for Privilege Escalation", "TA0004", "high"),
    Signature("log-clear", "Logs or a history removed.", i(r"wevtutil\s+cl", r"clear-eventlog", r"event\s*id[:=\s]*1102") + c(r"로그\s*(삭제|초기화)") + i(r"history\s+-c", r"del\s+.*\.evtx"), "T1070.001", "Clear Windows Event Logs", "TA0005", "high"),
    Signature("lateral", "Remote execution or an administrative share.", i(r"psexec", r"\bwmic\s+/node:", r"\\\\[\w.-]+\\(admin\$|c\$|ipc\$)", r"\bwinrm\b", r"enter-pssession"), "T1021", "Remote Services", "TA0008", "high"),
    Signature("c2-beacon", "Traffic of a command-and-control tool.", i(r"cobaltstrike", r"/(submit|beacon|gate)\.php", r"metasploit", r"meterpreter", r"\buser-agent:\s*$"), "T1071.001", "Web Protocols", "TA0011", "high"),
    Signature("exfil", "Data packed or sent away.", i(r"\b(curl|wget|invoke-webrequest)\b.*(post|--upload|-T)\b", r"\.(zip|rar|7z|tar\.gz)\b.*(upload|exfil|send)", r"scp\s+.*@"), "T1041", "Exfiltration Over C2 Channel", "TA0010", "high"),
    Signature("ransomware", "Files encrypted, or recovery switched off.", i(r"\.(locked|encrypted|crypt|wcry|wncry|locky)\b", r"ransom", r"readme.*decrypt", r"vssadmin\s+delete\s+shadows", r"bcdedit.*recoveryenabled\s+no"), "T1486", "Data Encrypted for Impact", "TA0040", "critical"),
)

#: Codes of the two findings that come from frequencies.
AUTH_FAILURES, ENUMERATION = "behavior-auth", "behavior-enum"

# The stage that a finding's category stands for on a timeline.
PHASE = {
    "recon-scanner": "Reconnaissance",
    "recon-enum": "Reconnaissance",
    ENUMERATION: "Reconnaissance",
    "sqli": "Initial Access",
    "xss": "Initial Access",
    "log4shell": "Initial Access",
    "cmd-injection": "Initial Access",
    "path-traversal": "Discovery",
    "powershell-enc": "Execution",
    "webshell": "Persistence",
    "persistence-reg": "Persistence",
    "privesc": "Privilege Escalation",
    "log-clear": "Defense Evasion",
    "brute-force": "Credential Access",
    "cred-dump": "Credential Access",
    AUTH_FAILURES: "Credential Access",
    "lateral": "Lateral Movement",
    "c2-beacon": "Command and Control",
    "exfil": "Exfiltration",
    "ransomware": "Impact",
}
