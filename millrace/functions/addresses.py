"""Addresses, domains and header text as column expressions; no Python runs in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ATOM = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_ADDRESS = rf"^{_ATOM}(?:\.{_ATOM})*@({_LABEL}(?:\.{_LABEL})*)$"


def bare_address(x: Column) -> Column:
    """Trimmed; what stands between the last < and the last >, where both are there in that order."""
    x = F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.when(x.rlike(r"(?s)^.*<[^<>]*>[^<>]*$"), F.regexp_extract(x, r"(?s)<([^<>]*)>[^<>]*$", 1)).otherwise(x)


def domain(x: Column) -> Column:
    """The domain of a dot-atom address in ASCII lower case; null where the address has no such form."""
    found = F.regexp_extract(bare_address(x), _ADDRESS, 1)
    return F.when(found != "", F.lower(found))


def quoted_domain(x: Column) -> Column:
    """As domain, but with quoted local parts too: the usual case stays native, and so does this one."""
    found = F.regexp_extract(bare_address(x), rf'^"(?:[^"\\]|\\.)*"@({_LABEL}(?:\.{_LABEL})*)$', 1)
    return F.coalesce(domain(x), F.when(found != "", F.lower(found)))


def strip_brackets(x: Column) -> Column:
    return F.regexp_replace(x, r"^[<>]+|[<>]+$", "")


def routing_domain(x: Column) -> Column:
    """What follows the last @ of the bracket-free text, in its own case; the whole where there is none."""
    return F.substring_index(strip_brackets(x), "@", -1)


def dns_name(x: Column) -> Column:
    """Trimmed, without trailing dots, lower case."""
    return F.lower(F.regexp_replace(x, r"^\s+|\.*\s*$", ""))


def metric_domain(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"\.+$", ""))


def mx_matches(mx: Column, pattern: Column) -> Column:
    """Equal names; or *. and a name that follows exactly one label of mx."""
    host, want = dns_name(mx), dns_name(pattern)
    rest = F.regexp_extract(host, r"^[^.]+\.(.+)$", 1)
    return (host == want) | (want.startswith("*.") & (rest != "") & (rest == F.substr(want, F.lit(3))))


def without_bcc(header: Column) -> Column:
    """Header text without the lines that begin with Bcc: in any case; folded continuations stay."""
    kept = F.filter(F.split(header, "\n"), lambda line: ~F.lower(line).startswith("bcc:"))
    return F.array_join(kept, "\n")


def with_signature(header: Column, signature: Column) -> Column:
    """Header text without lines that begin with DKIM-Signature:, then the new one and a blank line."""
    kept = F.filter(F.split(F.regexp_replace(header, r"\r?\n$", ""), "\r?\n"), lambda line: ~line.startswith("DKIM-Signature:"))
    return F.concat(F.array_join(kept, "\r\n"), F.lit("\r\n"), signature, F.lit("\r\n\r\n"))


def unstuffed(body: Column) -> Column:
    """One dot less at the start of each line that CRLF ends; the rest as it is."""
    return F.regexp_replace(body, r"(?s)(^|(?<=\r\n))\.(?=[^\n]*?\r\n|(?:(?!\r\n).)*\r\n)", "$1")


def subject_of(message: Column) -> Column:
    """The first Subject field of the header, unfolded; encoded words stay as they are."""
    head = F.regexp_extract(message, r"(?s)^(.*?)(?:\r?\n\r?\n|$)", 1)
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(head, r"(?is)(?:^|\n)subject:((?:[^\n]|\n[ \t])*)", 1), r"\r?\n[ \t]+", " ")), F.lit(""))
