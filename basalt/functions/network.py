"""IPv4 and IPv6 addresses, bit strings, byte strings and MAC addresses, over text, as Arrow-batched functions."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .udfs import bound


def _batch(f, kind: str):
    """A NULL-strict Column function that maps values batch by batch."""

    def call(*columns: Column) -> Column:
        def run(*cols: pd.Series) -> pd.Series:
            out = [None if any(v is None or v != v for v in row) else f(*row) for row in zip(*cols)]
            return pd.Series(out, dtype=object)

        run.__annotations__ = {"cols": pd.Series, "return": pd.Series}
        return bound(F.pandas_udf(run, kind))(*columns)

    return call


def _iface(s: str):
    return ipaddress.ip_interface(s)


def _shown(i) -> str:
    return str(i.ip) if i.network.prefixlen == i.max_prefixlen else f"{i.ip}/{i.network.prefixlen}"


def _merge(a: str, b: str) -> str:
    x, y = _iface(a), _iface(b)
    if x.version != y.version:
        raise ValueError("cannot merge addresses from different families")
    n = min(x.network.prefixlen, y.network.prefixlen)
    while ipaddress.ip_network((x.ip, n), strict=False) != ipaddress.ip_network((y.ip, n), strict=False):
        n -= 1
    return str(ipaddress.ip_network((x.ip, n), strict=False))


def _abbrev(s: str) -> str:
    i = _iface(s)
    if i.version == 6 or i.network.network_address != i.ip or "/" not in s:
        return _shown(i)
    kept = max(1, -(-i.network.prefixlen // 8))
    return ".".join(str(i.ip).split(".")[:kept]) + f"/{i.network.prefixlen}"


host = _batch(lambda s: str(_iface(s).ip), "string")
masklen = _batch(lambda s: _iface(s).network.prefixlen, "int")
family = _batch(lambda s: _iface(s).version, "int")
network = _batch(lambda s: str(_iface(s).network), "string")
broadcast = _batch(lambda s: f"{_iface(s).network.broadcast_address}/{_iface(s).network.prefixlen}" if _iface(s).network.prefixlen < _iface(s).max_prefixlen else str(_iface(s).network.broadcast_address), "string")
netmask = _batch(lambda s: str(_iface(s).netmask), "string")
hostmask = _batch(lambda s: str(_iface(s).hostmask), "string")
set_masklen = _batch(lambda s, n: _shown(ipaddress.ip_interface(f"{_iface(s).ip}/{int(n)}")), "string")
abbrev = _batch(_abbrev, "string")
inet_merge = _batch(_merge, "string")
inet_same_family = _batch(lambda a, b: _iface(a).version == _iface(b).version, "boolean")
contains = _batch(lambda a, b: _iface(a).version == _iface(b).version and _iface(b).network.subnet_of(_iface(a).network), "boolean")


def get_bit(bits: Column, n: int) -> Column:
    """The n-th bit from the left of a text of 0 and 1."""
    bad = F.raise_error(F.lit("bit index out of range")).cast("int")
    return F.when((F.length(bits) <= n) | F.lit(n < 0), bad).otherwise(bits.substr(n + 1, 1).cast("int"))


def set_bit(bits: Column, n: int, v: int) -> Column:
    bad = F.raise_error(F.lit("bit index out of range")).cast("string")
    return F.when((F.length(bits) <= n) | F.lit(n < 0), bad).otherwise(F.overlay(bits, F.lit(str(int(bool(v)))), F.lit(n + 1), F.lit(1)))


def get_byte(b: Column, n: int) -> Column:
    """The n-th byte of a binary value, 0 to 255."""
    return F.conv(F.substring(F.hex(b), 2 * n + 1, 2), 16, 10).cast("int")


def set_byte(b: Column, n: int, v: int) -> Column:
    return F.unhex(F.overlay(F.hex(b), F.lit(f"{v & 255:02X}"), F.lit(2 * n + 1), F.lit(2)))


def macaddr8_set7bit(mac: Column) -> Column:
    """Sets the 0x02 bit of the first byte of an aa:bb:.. address."""
    first = F.conv(F.substring(mac, 1, 2), 16, 10).cast("int").bitwiseOR(F.lit(2))
    return F.concat(F.lpad(F.lower(F.hex(first)), 2, "0"), mac.substr(F.lit(3), F.length(mac)))
