"""E-mail addresses and IPv4 addresses of simple texts, told by the standard library: what jobs are counted against."""

import ipaddress
import re

_WORD = re.compile(r"[^\s,;<>\"'()]+")
_PRIVATE = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")]


def mails_and_ips(text):
    """(detector, match, label) of each word that is an address."""
    out = []
    for word in _WORD.findall(text or ""):
        name, at, host = word.rpartition("@")
        if at and name and "." in host:
            out.append(("emails", word, f"[EMAIL:{host}]"))
            continue
        try:
            address = ipaddress.IPv4Address(word)
        except ValueError:
            continue
        out.append(("ips", word, "[PRIVATE_IPV4]" if any(address in n for n in _PRIVATE) else "[PUBLIC_IPV4]"))
    return out
