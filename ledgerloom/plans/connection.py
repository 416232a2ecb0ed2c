"""Where published tables go beside Parquet: a JDBC database, with plaintext refused beyond this machine."""

from __future__ import annotations

import ipaddress
import socket
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

Resolver = Callable[[str], list[str]]
# Networks that count as private.
PRIVATE = tuple(ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7"))
LOCAL = ("localhost", "127.0.0.1", "::1")


def addresses_of(host: str) -> list[str]:
    """All addresses of a host; none if it can't be resolved."""
    try:
        return [found[4][0] for found in socket.getaddrinfo(host, None)]
    except OSError:
        return []


def is_private(host: str, resolve: Resolver = addresses_of) -> bool:
    """Whether every address of the host lies in a private network; an unknown host isn't private."""
    try:
        found = [ipaddress.ip_address(a) for a in resolve(host)]
    except ValueError:
        return False
    return bool(found) and all(any(a.version == n.version and a in n for n in PRIVATE) for a in found)


@dataclass(frozen=True)
class Connection:
    """A JDBC target. Without TLS only this machine may be reached, or a private network if that is allowed explicitly."""

    url: str
    host: str
    user: str = "default"
    password: str = ""
    secure: bool = False
    allow_private_plaintext: bool = False

    def check(self, resolve: Resolver = addresses_of) -> Connection:
        if not self.secure and self.host not in LOCAL and not (self.allow_private_plaintext and is_private(self.host, resolve)):
            raise ValueError(f"{self.host!r} is not on this machine: use TLS, or allow plaintext for a private network")
        return self

    def write(self, df: DataFrame, table: str, batch_id: str) -> None:
        """Append a batch's rows, each stamped with the batch; the driver class comes with the session's jars."""
        from pyspark.sql import functions as F

        from ledgerloom.plans.publish import check_identifier

        options = {"url": self.check().url, "dbtable": check_identifier(table), "user": self.user, "password": self.password}
        df.withColumn("batch_id", F.lit(batch_id)).write.format("jdbc").options(**options).mode("append").save()
