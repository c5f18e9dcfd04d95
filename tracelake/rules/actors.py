"""Tools that text can name, and groups known for tools and techniques."""

from __future__ import annotations

from tracelake.rx import Rx

# Tool keys, patterns, and whether anyone may use the tool.
TOOLS = (
    ("mimikatz", Rx(r"mimikatz|sekurlsa|lsadump"), True),
    ("cobaltstrike", Rx(r"cobalt\s?strike|\bbeacon\b|teamserver"), True),
    ("sliver", Rx(r"\bsliver\b"), True),
    ("chaos", Rx(r"chaos.?rat|chaos_server|chaos\.db|chaosrat|chaos-container"), True),
    ("metasploit", Rx(r"metasploit|meterpreter|msfvenom"), True),
    ("empire", Rx(r"\bempire\b"), True),
    ("covenant", Rx(r"covenant|\bgrunt\b"), True),
    ("bruteratel", Rx(r"brute\s?ratel|\bbadger\b"), True),
    ("havoc", Rx(r"\bhavoc\b"), True),
    ("psexec", Rx(r"psexec"), True),
    ("impacket", Rx(r"impacket|wmiexec|smbexec|secretsdump|atexec"), True),
    ("plink", Rx(r"\bplink\b|\bputty\b"), True),
    ("frp", Rx(r"\bfrpc?\b|\bfrps\b|fast\s?reverse\s?proxy"), True),
    ("chisel", Rx(r"\bchisel\b"), True),
    ("ngrok", Rx(r"ngrok"), True),
    ("netcat", Rx(r"\b(ncat|netcat)\b"), True),
    ("nmap", Rx(r"\bnmap\b"), True),
    ("softperfect", Rx(r"netscan|softperfect"), True),
    ("advipscan", Rx(r"advanced.?ip.?scanner|advanced_ip_scanner"), True),
    ("rclone", Rx(r"rclone"), True),
    ("megasync", Rx(r"megasync|mega\.nz"), True),
    ("anydesk", Rx(r"anydesk"), True),
    ("sdelete", Rx(r"sdelete"), True),
    ("bloodhound", Rx(r"bloodhound|sharphound"), True),
    ("rubeus", Rx(r"\brubeus\b"), True),
    ("lazagne", Rx(r"lazagne"), True),
    ("winpeas", Rx(r"winpeas|linpeas"), True),
    ("procdump", Rx(r"procdump|nanodump"), True),
    ("plugx", Rx(r"\bplugx\b"), False),
    ("chinachopper", Rx(r"china\s?chopper"), False),
    ("quasar", Rx(r"quasar"), False),
    ("trickbot", Rx(r"trickbot"), False),
    ("carbanak", Rx(r"carbanak"), False),
    ("xagent", Rx(r"x-?agent|xtunnel"), False),
)
#: Names whose words may stand on two or three lines, as a line end is a space as well: their words, in order.
PARTED = (("cobalt", "strike"), ("brute", "ratel"), ("fast", "reverse", "proxy"), ("china", "chopper"))
# Groups, their techniques and tools.
ACTORS = (
    ("G0102", ("T1486", "T1003", "T1021", "T1071", "T1105", "T1490", "T1567"), ("cobaltstrike", "mimikatz", "psexec", "softperfect", "rclone", "anydesk", "trickbot")),
    ("G1032", ("T1486", "T1003", "T1021", "T1567", "T1490"), ("mimikatz", "psexec", "softperfect", "rclone", "megasync", "impacket")),
    ("G0008", ("T1486", "T1003", "T1021", "T1490"), ("mimikatz", "psexec", "softperfect", "rclone", "megasync", "advipscan")),
    ("G1017", ("T1090", "T1078", "T1046", "T1003", "T1552"), ("frp", "impacket", "mimikatz")),
    ("G0096", ("T1505", "T1071", "T1003", "T1059", "T1105"), ("cobaltstrike", "mimikatz", "chinachopper", "plink")),
    ("G0045", ("T1071", "T1003", "T1090", "T1078"), ("plink", "quasar", "mimikatz", "psexec")),
    ("G0049", ("T1059", "T1505", "T1090", "T1071"), ("plink", "mimikatz")),
    ("G0016", ("T1059", "T1071", "T1003", "T1078", "T1027"), ("cobaltstrike", "mimikatz")),
    ("G0007", ("T1071", "T1003", "T1059", "T1566"), ("xagent", "mimikatz")),
    ("G0032", ("T1105", "T1486", "T1071", "T1059", "T1003"), ("mimikatz", "metasploit")),
    ("G1015", ("T1078", "T1621", "T1003", "T1090"), ("mimikatz", "impacket", "ngrok", "anydesk", "psexec")),
    ("G0046", ("T1059", "T1071", "T1055", "T1486"), ("cobaltstrike", "carbanak", "mimikatz")),
    ("G0129", ("T1071", "T1105", "T1547", "T1027"), ("plugx", "cobaltstrike")),
    ("G0010", ("T1071", "T1027", "T1090", "T1003"), ("mimikatz",)),
    ("G0035", ("T1078", "T1003", "T1046", "T1133"), ("impacket", "mimikatz", "nmap")),
)
