"""Network values as columns."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import bound

_OCTET = r"(?:0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def ipv4_number(ip: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    parts = [F.split_part(ip, F.lit("."), F.lit(i)).try_cast("long") for i in (1, 2, 3, 4)]
    value = parts[0] * 16777216 + parts[1] * 65536 + parts[2] * 256 + parts[3]
    return F.when(ip.rlike(IPV4), value)


def in_network(ip: Column, cidr: str) -> Column:
    """Whether an IPv4 address lies in ``cidr`` (host bits allowed); null for other text. IPv6 networks are an error."""
    net = ipaddress.ip_network(cidr, strict=False)
    if net.version != 4:
        raise ValueError("only IPv4 networks can be searched")
    return ipv4_number(ip).between(int(net.network_address), int(net.broadcast_address))


@F.pandas_udf(T.StringType())
def _canonical(values: pd.Series) -> pd.Series:
    def one(text):
        try:
            return str(ipaddress.ip_address(text))
        except ValueError:
            return None

    return values.map(one, na_action="ignore")


def ip(value: Column, v6: bool = True) -> Column:
    """A valid address in canonical text, else null. Only values with a colon leave the JVM, and only with ``v6``."""
    plain = F.when(value.rlike(IPV4), value)
    return F.coalesce(plain, _canonical(F.when(value.contains(":"), value))) if v6 else plain


def port(value: Column) -> Column:
    """A whole number from 0 to 65535, else null. Text is no number, whatever it says: it goes through ``int`` first."""
    whole = F.typeof(value).isin("tinyint", "smallint", "int", "bigint")
    return F.when(whole, bound(value.try_cast("int"), lambda number: F.when(number.between(0, 65535), number)))


def mac(value: Column) -> Column:
    """A hardware address as six colon-separated pairs in lower case, else null."""
    digits = F.lower(F.regexp_replace(value, "[^0-9A-Fa-f]", ""))
    pairs = F.regexp_replace(digits, "(..)(?!$)", "$1:")
    return F.when(F.length(digits) == 12, pairs)
