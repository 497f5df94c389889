"""Connections: option builders for JDBC sources, secrets and keys. No plan is built here."""

from __future__ import annotations

import base64
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from pathlib import Path


class ConnectionFailure(ValueError):
    """A connection cannot be described."""


@dataclass(frozen=True)
class Connection:
    kind: str  # POSTGRESQL or SNOWFLAKE
    database: str | None = None
    schema: str | None = None
    host: str | None = None
    port: int | None = None
    url: str | None = None
    user: str | None = None
    password: str | None = None
    account: str | None = None
    warehouse: str | None = None
    role: str | None = None
    auth_mode: str = "PASSWORD"  # or KEY_PAIR
    private_key_pem: str | None = None
    private_key_path: str | None = None
    private_key_base64: str | None = None
    private_key_passphrase: str | None = None
    secret: str | None = None
    ssl_mode: str = "prefer"


#: Looks up a secret by path; returns its fields, or None if it has none.
SecretStore = Callable[[str], dict[str, str] | None]


@dataclass
class SecretConfig:
    """Where secrets lie in a key-value store."""

    enabled: bool = False
    engine: str = "secret"
    version: int = 2
    prefix: str = ""

    def path(self, name: str) -> str:
        middle = "data/" if self.version == 2 else ""
        return f"{self.engine}/{middle}{self.prefix.strip('/') + '/' if self.prefix else ''}{name}"


def _blank(x: str | None) -> bool:
    return x is None or not x.strip()


def resolve_password(c: Connection, store: SecretStore | None = None) -> str:
    """The secret store's first, then the one given."""
    found = store(c.secret) if store and not _blank(c.secret) else None
    password = (found or {}).get("password") or c.password
    if _blank(password):
        raise ConnectionFailure("no password: neither the secret store nor the request has one")
    return password


def resolve_key(c: Connection, store: SecretStore | None = None) -> bytes:
    """The private key; fields of the secret store go before those of a copy of the request."""
    found = (store(c.secret) if store and not _blank(c.secret) else None) or {}
    names = {"private_key_pem", "private_key_path", "private_key_base64", "private_key_passphrase"}
    return load_key(replace(c, **{k: v for k, v in found.items() if k in names and not _blank(v)}))


def load_key(c: Connection) -> bytes:
    """DER bytes of the PKCS#8 key, from PEM text, else a file (PEM or DER), else base64."""
    if not _blank(c.private_key_pem):
        return _pem(c.private_key_pem, c.private_key_passphrase)
    if not _blank(c.private_key_path):
        path = Path(c.private_key_path)
        if not path.is_file():
            raise ConnectionFailure(f"no private key at {path}")
        raw = path.read_bytes()
        return _pem(raw.decode("ascii"), c.private_key_passphrase) if raw.lstrip().startswith(b"-----BEGIN") else raw
    if not _blank(c.private_key_base64):
        return _decoded(c.private_key_base64)
    raise ConnectionFailure("KEY_PAIR needs a private key: PEM text, a path or base64")


def _decoded(text: str) -> bytes:
    try:
        return base64.b64decode("".join(text.split()), validate=True)
    except ValueError as e:
        raise ConnectionFailure("the private key is not valid base64") from e


def _pem(text: str, passphrase: str | None) -> bytes:
    body = [x.strip() for x in text.strip().splitlines()]
    if not body or not body[0].startswith("-----BEGIN") or not body[-1].startswith("-----END"):
        raise ConnectionFailure("the private key is not in PEM form")
    if "ENCRYPTED" in body[0] and _blank(passphrase):
        raise ConnectionFailure("the private key is encrypted and needs a passphrase")
    if "RSA PRIVATE KEY" in body[0]:
        raise ConnectionFailure("the private key must be in PKCS#8 form")
    return _decoded("".join(body[1:-1]))


def postgresql_options(c: Connection, store: SecretStore | None = None) -> dict[str, str]:
    url = c.url if not _blank(c.url) else f"jdbc:postgresql://{c.host or 'localhost'}:{c.port or 5432}/{c.database or 'postgres'}"
    out = {"url": url, "driver": "org.postgresql.Driver", "sslmode": c.ssl_mode, "connectTimeout": "30", "socketTimeout": "60"}
    if c.user:
        out |= {"user": c.user, "password": resolve_password(c, store)}
    if not _blank(c.schema):
        out["currentSchema"] = c.schema
    return out


def snowflake_options(c: Connection, store: SecretStore | None = None) -> dict[str, str]:
    if _blank(c.url) and _blank(c.account):
        raise ConnectionFailure("a Snowflake connection needs a url or an account")
    url = c.url if not _blank(c.url) else f"jdbc:snowflake://{c.account.removesuffix('.snowflakecomputing.com')}.snowflakecomputing.com/"
    out = {"url": url, "driver": "net.snowflake.client.jdbc.SnowflakeDriver", "loginTimeout": "30", "networkTimeout": "60"}
    out |= {k: v for k, v in {"user": c.user, "db": c.database, "schema": c.schema, "warehouse": c.warehouse, "role": c.role}.items() if not _blank(v)}
    if c.auth_mode == "KEY_PAIR":
        out |= {"authenticator": "snowflake_jwt", "pem_private_key": base64.b64encode(resolve_key(c, store)).decode()}
    else:
        out["password"] = resolve_password(c, store)
    return out


def normalised(c: Connection) -> Connection:
    """Blank names become defaults: no database and schema public; Snowflake's are in upper case."""
    database, schema = (None if _blank(x) else x.strip() for x in (c.database, c.schema))
    if c.kind == "SNOWFLAKE":
        return replace(c, database=database and database.upper(), schema=(schema or "PUBLIC").upper())
    return replace(c, database=database, schema=schema or "public")


@dataclass
class Connectors:
    """Option builders by database type; more may be added."""

    builders: dict[str, Callable] = field(default_factory=lambda: {"POSTGRESQL": postgresql_options, "SNOWFLAKE": snowflake_options})

    def options(self, c: Connection, store: SecretStore | None = None) -> dict[str, str]:
        if c.kind not in self.builders:
            raise ConnectionFailure(f"no connector for {c.kind}; available: {', '.join(sorted(self.builders))}")
        return self.builders[c.kind](normalised(c), store)
