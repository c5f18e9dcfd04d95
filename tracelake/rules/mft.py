"""Rules over file-system records."""

from __future__ import annotations

from tracelake.rx import Rx, c, i

# Techniques of file findings.
TECHNIQUES = {
    "T1070.006": ("Indicator Removal: Timestomp", "TA0005"),
    "T1070.004": ("Indicator Removal: File Deletion", "TA0005"),
    "T1564.004": ("Hide Artifacts: NTFS File Attributes", "TA0005"),
    "T1036.007": ("Masquerading: Double File Extension", "TA0005"),
    "T1036.005": ("Masquerading: Match Legitimate Name or Location", "TA0005"),
    "T1105": ("Ingress Tool Transfer", "TA0011"),
    "T1071.001": ("Application Layer Protocol: Web Protocols", "TA0011"),
    "T1505.003": ("Server Software Component: Web Shell", "TA0003"),
    "T1059.001": ("Command and Scripting Interpreter: PowerShell", "TA0002"),
    "T1003": ("OS Credential Dumping", "TA0006"),
    "T1074.001": ("Data Staged: Local Data Staging", "TA0009"),
}
# Extensions and process names.
EXECUTABLE = ("exe", "dll", "sys", "scr", "com", "pif", "cpl", "ps1", "psm1", "bat", "cmd", "vbs", "vbe", "js", "jse", "wsf", "hta", "jar", "msi", "lnk")
RISKY = ("exe", "dll", "ps1", "bat", "vbs", "js", "jsp", "jspx", "php", "aspx", "asp", "scr", "hta", "jar", "sys", "db")
PROTECTED = ("svchost.exe", "lsass.exe", "services.exe", "csrss.exe", "winlogon.exe", "smss.exe", "wininit.exe", "explorer.exe", "taskhost.exe", "spoolsv.exe", "rundll32.exe", "conhost.exe", "dllhost.exe")
# Places, matched on the lower-cased path; the first that matches counts.
SUSPICIOUS = (
    ("windows-tasks", Rx(r"/windows/tasks/", False), "high"),
    ("windows-debug", Rx(r"/windows/debug/", False), "high"),
    ("windows-data", Rx(r"/windows/(fonts|help|addins|cursors|media)/", False), "high"),
    ("recovery", Rx(r"/recovery/", False), "medium"),
    ("intel-root", Rx(r"(^|/)intel/", False), "medium"),
    ("user-temp", Rx(r"/users/[^/]+/appdata/local/temp/", False), "high"),
    ("windows-temp", Rx(r"/windows/temp/", False), "high"),
    ("downloads", Rx(r"/users/[^/]+/downloads/", False), "high"),
    ("recycle-bin", Rx(r"/\$recycle\.bin/", False), "high"),
    ("desktop", Rx(r"/users/[^/]+/desktop/", False), "medium"),
    ("public", Rx(r"/users/public/", False), "medium"),
    ("perflogs", Rx(r"/perflogs/", False), "medium"),
    ("temp", Rx(r"(^|/)(temp|tmp)/", False), "medium"),
)
# Patterns of paths and names.
DRIVE_ROOT = i(r"^/[^/]+\.(exe|scr|bat|cmd|com|pif|ps1|vbs|js|hta|jar)$")
ARTIFACT = i(r"\.(exe|dll|bin|dat|etl|cab|config|toc|hit|dir|cmf|jpg|jpeg|png|gif|ico|log|tmp|sys|mum|cat|que|jrs|chk|jfm|mdb|blf|xml|txt|json|evtx|customdestinations-ms|automaticdestinations-ms|regtrans-ms|winsat\.etl)/[^/]+$")
EXPECTED = c(r"/windows/", r"/program files( \(x86\))?/", r"/programdata/", r"/users/[^/]+/appdata/(local|locallow|roaming)/", r"/\$recycle\.bin/")
SYSTEM = c(r"/windows/winsxs/", r"/windows/system32/", r"/windows/syswow64/", r"/windows/servicing/", r"/windows/softwaredistribution/", r"/windows/installer/", r"/program files( \(x86\))?/", r"/windows/assembly/")
LEGITIMATE = c(r"/(windows|windows/system32|windows/syswow64|windows/winsxs)/")
KNOWN_STREAM = i(r":(zone\.identifier|encryptable|wofcompresseddata|favicon|smartscreen|win32app\w*|afp_(afpinfo|resource))$")
BENIGN = i(r"^(nlsdata\w*|nlslexicons\w*|nl7data\w*|mswb7\w*|korwbrkr|prm\w+|mls\d+\w*|mpengine|mpasbase|mpasdlta|mpavbase|mpavdlta|mpoav|mssp7en|sortdefault)\.(dll|nls)$")
DOUBLE = i(r"\.(pdf|docx?|xlsx?|pptx?|jpe?g|png|gif|txt|zip|rar|mp4|mp3|csv|hwp)\.(exe|scr|bat|cmd|com|pif|vbs|vbe|js|jse|ps1|wsf|hta|jar|lnk)$")
ORPHAN = i(r"^(nofnrecord|nosirecord|\.)")
# Names of attack tools, their techniques and severities.
TOOLS = (
    ("tool-sliver", i(r"\bsliver\b|sliver.*\.(exe|dll|bin)$"), "T1071.001", "critical"),
    ("tool-cobaltstrike", i(r"cobaltstrike|cobalt_strike|^beacon\.(exe|dll)$|^artifact(32|64)?\.exe$|teamserver"), "T1071.001", "critical"),
    ("tool-metasploit", i(r"meterpreter|metasploit|^msf(venom|console)?\b"), "T1071.001", "critical"),
    ("tool-havoc", i(r"\bhavoc\b|demon\.(exe|dll|bin)$"), "T1071.001", "critical"),
    ("tool-merlin", i(r"\bmerlin\b|^covenant|grunt(stager)?\.exe$"), "T1071.001", "critical"),
    ("tool-chaos", i(r"^chaos_server|^chaos\.db$|^chaos_package|^curlchaos"), "T1071.001", "critical"),
    ("tool-rat", i(r"quasar|asyncrat|njrat|remcos|agenttesla|formbook|nanocore|darkcomet|venomrat"), "T1071.001", "critical"),
    ("tool-mimikatz", i(r"^mimikatz|sekurlsa|lsadump|^mimilib\.dll$|^mimidrv"), "T1003", "critical"),
    ("tool-lsassdump", i(r"^procdump(64)?\.exe$|lsass.*\.dmp$|^nanodump"), "T1003", "critical"),
    ("tool-psexec", i(r"^psexec(svc)?\.exe$|^paexec\.exe$|^csexec"), "T1105", "high"),
    ("tool-adkit", i(r"^(rubeus|sharphound|bloodhound|lazagne|seatbelt|winpeas|powerup|powerview|certify|kerbrute|impacket)\b"), "T1105", "high"),
    ("tool-tunnel", i(r"^chisel|^frpc?\.exe$|^frps\.exe$|^ngrok|^gost\.exe$|^htran|^plink\.exe$|^stowaway|^revsocks"), "T1105", "high"),
    ("tool-netcat", i(r"^(nc|ncat|netcat)(64)?\.exe$"), "T1105", "high"),
)
