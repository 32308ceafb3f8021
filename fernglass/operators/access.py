"""Access to the guarded tier as operators over requests: signed claims, identities, client tokens, the gates before a query and the record of
every outcome. Signatures are checked by expressions, so that no token leaves the JVM."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import logging
import re
import secrets
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least length of a client's token, names of clients and tenants, seconds that an approval and an unlocked key hold, and the days a token may.
TOKEN_CHARS, CLIENT_NAME, TENANT_NAME, GRANT_SECONDS, KEY_SECONDS, TOKEN_DAYS = 32, r"^[a-z0-9][a-z0-9_-]{0,63}$", r"^[a-z][a-z0-9_-]{1,47}$", 300, 900, 730


class AccessError(ValueError):
    """Settings or names that can't be used."""


def hmac_sha256(message: Column, key: bytes) -> Column:
    """The HMAC of a text or bytes with SHA-256, as bytes: two digests over the key's padded blocks."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    digest = lambda content: F.unhex(F.sha2(content, 256))
    return digest(F.concat(outer, digest(F.concat(inner, message.cast("binary")))))


def base64url(content: Column) -> Column:
    return F.regexp_replace(F.translate(F.base64(content), "+/", "-_"), r"[=\s]", "")


def from_base64url(text: Column) -> Column:
    """The bytes of a text in the alphabet for addresses, without padding; null where it is no such text."""
    whole = F.translate(text, "-_", "+/")
    padded = F.concat(whole, F.repeat(F.lit("="), F.pmod(-F.length(whole), F.lit(4))))
    return F.when(text.rlike("^[A-Za-z0-9_-]+$"), F.try_to_binary(padded, F.lit("base64")))


def signed_token(claims: Column, key: bytes) -> Column:
    """A token ``head.claims.signature`` of claims as JSON text."""
    head = base64.urlsafe_b64encode(b'{"alg":"HS256","typ":"JWT"}').rstrip(b"=").decode()
    body = F.concat(F.lit(head + "."), base64url(claims.cast("binary")))
    return F.concat(body, F.lit("."), base64url(hmac_sha256(body, key)))


def claims_of(token: Column) -> Column:
    """The claims of a token as JSON text, not verified: for choosing a path, never for granting. Null for what is not three parts with an object in the middle."""
    text = F.decode(from_base64url(F.get(F.split(token, r"\."), 1)), "UTF-8")
    return F.when((F.size(F.split(token, r"\.")) == 3) & text.rlike(r"^\s*\{") & F.get_json_object(text, "$").isNotNull(), text)


def is_scoped(token: Column) -> Column:
    """Whether a token names the collections it is for: its claim ``access`` is a list."""
    return F.coalesce(F.get_json_object(claims_of(token), "$.access").rlike(r"^\s*\["), F.lit(False))


def with_identity(requests: DataFrame, key: bytes, issuer: str, emails: list[str], roles: list[str], now: float, token: str = "assertion") -> DataFrame:
    """Requests with ``subject``, ``principal`` and ``refusal``: the verified identity of the column ``token``, or why there is none.

    A token must be signed with ``key`` and state who issued it, whom it is about and until when; e-mail and role must be on their lists, of which an empty
    one admits nobody. A missing token refuses as a wrong one does."""
    parts = F.split(F.col(token), r"\.")
    claims = claims_of(F.col(token))
    head = F.decode(from_base64url(F.get(parts, 0)), "UTF-8")
    body = F.concat_ws(".", F.get(parts, 0), F.get(parts, 1))
    good = F.coalesce((from_base64url(F.get(parts, 2)) == hmac_sha256(body, key)) & (F.get_json_object(head, "$.alg") == "HS256"), F.lit(False))
    get = lambda name: F.coalesce(F.get_json_object(claims, f"$.{name}"), F.lit(""))
    email, role, ends = F.lower(F.trim(get("email"))), F.lower(F.trim(get("role"))), get("exp").try_cast("double")
    refusal = (
        F.when(F.coalesce(F.col(token), F.lit("")) == "", "no identity")
        .when(claims.isNull() | ~good, "not verified")
        .when(ends.isNull() | (get("sub") == "") | (get("iss") == ""), "claims missing")
        .when(ends <= now, "expired")
        .when(get("iss") != issuer, "wrong issuer")
        .when(~email.isin(*[e.lower() for e in emails]) if emails else F.lit(True), "e-mail not permitted")
        .when(~role.isin(*[r.lower() for r in roles]) if roles else F.lit(True), "role not permitted")
    )
    rows = requests.withColumn("refusal", refusal)
    shown = F.concat(email, F.lit(" ("), get("name"), F.lit(", "), role, F.lit(")"))
    return rows.withColumns({"subject": F.when(F.col("refusal").isNull(), get("sub")), "principal": F.when(F.col("refusal").isNull(), shown)})


def client_tokens(raw: str | None) -> dict[str, str]:
    """``name:token,name:token`` by name; anything doubtful raises, as an entry that is passed over looks like a client shut out."""
    out: dict[str, str] = {}
    for entry in (e.strip() for e in (raw or "").split(",") if e.strip()):
        name, colon, token = (p.strip() for p in entry.partition(":"))
        faults = {
            "is no name:token": not colon or not name, "has a name of other than small letters, digits, - and _": not re.match(CLIENT_NAME, name),
            f"has a token of under {TOKEN_CHARS} characters": len(token) < TOKEN_CHARS, "is named twice": name in out, "has another's token": token in out.values(),
        }
        if fault := next((f for f, wrong in faults.items() if wrong), None):
            raise AccessError(f"client {name or entry[:8]!r} {fault}")
        out[name] = token
    return out


def client_of(authorization: Column, tokens: dict[str, str]) -> Column:
    """The client whose token stands in a header ``Bearer token``, or null. Digests are looked up, so that time says nothing of tokens."""
    supplied = F.trim(F.regexp_extract(F.trim(authorization), r"(?i)^bearer\s+(.+)$", 1))
    if not tokens:
        return F.lit(None).cast("string")
    known = F.create_map(*(F.lit(x) for name, token in tokens.items() for x in (hashlib.sha256(token.encode()).hexdigest(), name)))
    return F.when(supplied != "", F.try_element_at(known, F.sha2(supplied, 256)))


def gated(requests: DataFrame, grants: DataFrame, *, unlocked: bool, key: bytes, issuer: str, emails: list[str], roles: list[str], now: float) -> DataFrame:
    """Requests ``tool, query_hash, transport, assertion`` with ``principal, decision, reason``: allowed, pending or denied.

    A sealed store denies before anything else is looked at. The command line passes as itself. Other requests need a verified identity and a grant
    ``subject, query_hash, approved_at`` of the same request that is at most ``GRANT_SECONDS`` old; without one they are pending."""
    rows = with_identity(requests, key, issuer, emails, roles, now)
    held = grants.filter((F.col("approved_at") <= now) & (F.col("approved_at") >= now - GRANT_SECONDS)).select("subject", "query_hash").distinct().withColumn("_granted", F.lit(True))
    rows = rows.join(held, ["subject", "query_hash"], "left")
    local = F.coalesce(F.col("transport") == "cli", F.lit(False))
    reason = F.when(F.lit(not unlocked), "sealed").when(local, None).when(F.col("refusal").isNotNull(), F.concat(F.lit("identity: "), "refusal")).when(F.col("_granted").isNull(), "awaiting approval")
    decision = F.when(F.lit(not unlocked), "denied").when(local, "allowed").when(F.col("refusal").isNotNull(), "denied").when(F.col("_granted").isNull(), "pending").otherwise("allowed")
    who = F.when(F.lit(unlocked) & local, "cli:local").when(F.lit(unlocked), F.col("principal"))
    return rows.select(*requests.columns, who.alias("principal"), decision.alias("decision"), reason.alias("reason"))


def audit_entries(decisions: DataFrame, at: str) -> DataFrame:
    """What is recorded of decisions: who asked what and what came of it, with no argument and no text."""
    return decisions.select(F.lit(at).alias("ts"), "principal", "transport", "tool", "query_hash", "decision", "reason")


def recorded(entries: DataFrame, append: Callable[[DataFrame], None], journal: logging.Logger) -> bool:
    """Whether ``append`` took the entries. If it fails, as where the store is sealed, the journal gets a line for each tool, decision and reason, so
    that a denial is known where it can't be stored; the failure itself doesn't hide what was decided."""
    try:
        append(entries)
        return True
    except Exception as error:  # noqa: BLE001
        for r in entries.groupBy("tool", "decision", "reason").agg(F.count("*").alias("n")).orderBy("tool", "decision", "reason").collect():
            journal.warning("not stored (%s): %s %s %s, %d times", type(error).__name__, r["tool"], r["decision"], r["reason"], r["n"])
        return False


def audit_tail(log: DataFrame, limit: int = 50) -> DataFrame:
    """The newest entries of a log by id: a top-k without a full sort."""
    return log.orderBy(F.desc("id")).limit(limit)


class KeyHolder:
    """A key that is held for ``ttl`` seconds after it was last given, and overwritten when it goes."""

    def __init__(self, ttl: float = KEY_SECONDS) -> None:
        self.ttl, self._key, self._until = ttl, bytearray(), 0.0

    def unlock(self, key: bytes) -> None:
        self._key, self._until = bytearray(key), time.monotonic() + self.ttl

    def lock(self) -> None:
        self._key[:] = bytes(len(self._key))
        self._key = bytearray()

    def key(self) -> bytes | None:
        if self._key and time.monotonic() > self._until:
            self.lock()
        return bytes(self._key) or None


def derive_key(passphrase: str, salt: bytes | None = None) -> tuple[bytes, bytes, str]:
    """``(key, salt, verifier)`` of a passphrase by a memory-hard function; the verifier tells a wrong passphrase without the key."""
    salt = salt or secrets.token_bytes(16)
    key = hashlib.scrypt(passphrase.encode(), salt=salt, n=1 << 14, r=8, p=1, maxmem=64 << 20, dklen=32)
    return key, salt, hmac.new(key, b"verifier", hashlib.sha256).hexdigest()


def valid_tenant(name: Column, reserved: list[str]) -> Column:
    """Whether a name can be a tenant's: small letters, digits, - and _, two to 48 of them, a letter first, no two _ together, not reserved."""
    return name.rlike(TENANT_NAME) & ~name.contains("__") & ~(name.isin(*reserved) if reserved else F.lit(False))


def next_generation(previous: int | None, now_ns: int) -> int:
    """A generation that is later than the one before, whatever the clock says."""
    return max(now_ns, (previous or 0) + 1)


def tenants_with(registry: DataFrame, name: str, now_ns: int, at: str, reserved: list[str]) -> DataFrame:
    """The registry ``tenant, generation, created_at`` with a new tenant; a name that can't be one, or is one, raises."""
    if not re.match(TENANT_NAME, name) or "__" in name or name in reserved:
        raise AccessError(f"{name!r} can't be a tenant's name")
    if registry.filter(F.col("tenant") == name).limit(1).count():
        raise AccessError(f"{name!r} is a tenant already")
    return registry.unionByName(registry.sparkSession.createDataFrame([(name, next_generation(None, now_ns), at)], "tenant string, generation long, created_at string"))


def revoked(registry: DataFrame, name: str, now_ns: int) -> DataFrame:
    """The registry with a later generation of a tenant, so that no token issued so far holds."""
    later = F.greatest(F.lit(now_ns), F.col("generation") + 1)
    return registry.withColumn("generation", F.when(F.col("tenant") == name, later).otherwise(F.col("generation")))


def tenant_list(registry: DataFrame, chunks: DataFrame) -> DataFrame:
    """``tenant, created_at, valid_since, points`` by name; a tenant without a collection has null points."""
    counts = chunks.groupBy("tenant").agg(F.count("*").alias("points"))
    since = F.date_format(F.timestamp_seconds(F.floor(F.col("generation") / 1_000_000_000)), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return registry.join(counts, "tenant", "left").select("tenant", "created_at", since.alias("valid_since"), "points").orderBy("tenant")


def tenant_token(name: str, generation: int, key: bytes, now: int, days: int = 90, access: str = "rw") -> str:
    """A token for a tenant's collections that ends after 1 to ``TOKEN_DAYS`` days and with the tenant's generation."""
    if not 1 <= days <= TOKEN_DAYS:
        raise AccessError(f"days must be 1 to {TOKEN_DAYS}")
    claims = {"sub": name, "iat": now, "exp": now + days * 86_400, "access": [{"collection": c, "access": access} for c in (name, f"{name}__meta")], "generation": generation}
    cut = lambda raw: base64.urlsafe_b64encode(raw).rstrip(b"=")
    body = cut(b'{"alg":"HS256","typ":"JWT"}') + b"." + cut(json.dumps(claims, separators=(",", ":")).encode())
    return (body + b"." + cut(hmac.new(key, body, hashlib.sha256).digest())).decode()
