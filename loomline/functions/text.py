"""Predicates and scalar functions over names, paths, literals and settings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("low", "medium", "high")
_WEAK = "MD2 MD4 MD5 SHA1 DES 3DES DESEDE TRIPLEDES RC2 RC4 ARC4 ARCFOUR BLOWFISH IDEA CAST5 SEED ECB NULL EXPORT ANON SSLV2 SSLV3 TLSV1 TLSV1.0 TLSV1.1"


def matches_call(callee: Column, pattern: str) -> Column:
    """``name`` exact; ``a.b`` the name or a dotted suffix; ``*.m`` the last segment of several."""
    if pattern.startswith("*."):
        return callee.contains(".") & (F.element_at(F.split(callee, r"\."), -1) == pattern[2:])
    return (callee == pattern) | (callee.endswith("." + pattern) if "." in pattern else F.lit(False))


def matches_crypto(callee: Column, pattern: str) -> Column:
    """As :func:`matches_call`, and ``PREFIX_*`` on the last segment."""
    if pattern.endswith("_*"):
        return F.element_at(F.split(callee, r"\."), -1).startswith(pattern[:-1])
    return matches_call(callee, pattern)


def strip_keys(path: Column) -> Column:
    """``d['k'].f`` to ``d.f``."""
    return F.regexp_replace(path, r"\[[^\]]*\]", "")


def matches_source(path: Column, pattern: str) -> Column:
    """Without keys, the pattern itself, or it at the beginning, the end or inside, between dots."""
    return F.contains(F.concat(F.lit("."), strip_keys(path), F.lit(".")), F.lit(f".{pattern}."))


def matches_wildcard(text: Column, pattern: Column) -> Column:
    """``*`` is any text, the rest itself; the whole text must match. For small pattern tables only."""
    quoted = F.concat(F.lit("^(?s)\\Q"), F.replace(pattern, F.lit("*"), F.lit("\\E.*\\Q")), F.lit("\\E$"))
    return F.regexp_like(text, quoted)


def matches_module(module: Column, pattern: str) -> Column:
    """P5: the pattern, then nothing, ``.``, ``/`` or ``:``."""
    return (module == pattern) | F.substring(module, 1, len(pattern) + 1).isin(*[pattern + c for c in "./:"])


def is_environment(description: Column, words: list[str]) -> Column:
    """A word of ``words`` in the lower-cased text; ``=word`` the text itself."""
    low = F.lower(description)
    out = F.lit(False)
    for w in words:
        out = out | ((low == w[1:]) if w.startswith("=") else low.contains(w))
    return out


def unless(matched: Column, callee: Column, names: list[str]) -> Column:
    """What matches, but for look-alikes."""
    out = matched
    for n in names:
        out = out & ~matches_call(callee, n)
    return out


def selected(pos: Column, kw: Column, selector: str | int | None) -> Column:
    """Any argument, the n-th positional one, or the named one."""
    if selector is None:
        return F.lit(True)
    return kw.isNull() & (pos == selector) if isinstance(selector, int) else F.coalesce(kw == selector, F.lit(False))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def excerpt(code: Column, length: int = 100) -> Column:
    """White space put together, the first 100 characters."""
    return F.substring(F.trim(F.regexp_replace(code, r"\s+", " ")), 1, length)


def shorten(text: Column) -> Column:
    """White space put together; over 80 characters the first 77 and three dots."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(one) > 80, F.concat(F.substring(one, 1, 77), F.lit("..."))).otherwise(one)


def relative(path: Column, folder: str) -> Column:
    """Without the working folder and ``./``, with forward slashes."""
    slashes = F.replace(path, F.lit("\\"), F.lit("/"))
    at = folder.rstrip("/") + "/"
    inside = F.when(slashes.startswith(at), F.substring(slashes, len(at) + 1, 1 << 20)).otherwise(slashes)
    return F.regexp_replace(inside, r"^(\./)+", "")


def root(path: Column) -> Column:
    return F.regexp_extract(path, r"^[^.\[-]+", 0)


def ancestors(path: Column) -> Column:
    """A path and all that it lies in: ``a.b[0]``, ``a.b``, ``a``; equal joins on it test prefixes."""
    at = F.sequence(F.lit(1), F.greatest(F.char_length(path), F.lit(1)))
    cuts = F.filter(at, lambda i: (i == F.char_length(path)) | F.substr(path, i + 1, F.lit(1)).isin(".", "["))
    return F.reverse(F.transform(cuts, lambda i: F.substr(path, F.lit(1), i)))


def unquote(text: Column) -> Column:
    """A string literal without prefix and quotes."""
    return F.regexp_replace(F.regexp_replace(text, "^[rRbBuUfF]{0,2}(\"\"\"|'''|\"|'|`)", ""), "(\"\"\"|'''|\"|'|`)$", "")


def fold_concat(text: Column) -> Column:
    """Literals joined by ``+`` as one: ``'a' + 'b'`` to ``'ab'``."""
    return F.regexp_replace(text, "(['\"])\\s*\\+\\s*\\1", "")


def words(text: Column) -> Column:
    """Runs of letters and digits, in capitals."""
    return F.filter(F.split(F.upper(text), "[^A-Z0-9]+"), lambda w: w != "")


def weak_word(text: Column) -> Column:
    """The first word that names a weak algorithm or protocol, or null. ``!RC4`` and ``-MD5`` deny it."""
    tokens = F.filter(F.split(F.upper(text), r"[\s:,;+/_|]+"), lambda w: (w != "") & ~w.startswith("!") & ~w.startswith("-"))
    split = F.flatten(F.transform(tokens, lambda w: F.concat(F.array(w), F.split(w, "-"))))
    return F.try_element_at(F.filter(split, lambda w: w.isin(*_WEAK.split())), F.lit(1))


def key_issue(algorithm: Column, bits: Column) -> Column:
    """What is wrong with a key of so many bits, or null."""
    a = F.upper(algorithm)
    short = F.when(a.isin("RSA", "DSA", "DH"), bits < 2048).when(a.isin("EC", "ECDSA", "ECDH"), bits < 224).when(a.isin("AES", "HMAC"), bits < 128)
    return F.when(short, F.concat(a, F.lit(" key of "), bits.cast("string"), F.lit(" bits")))


def quantum(algorithm: Column) -> Column:
    """Whether a large quantum computer breaks it."""
    return F.upper(algorithm).isin("RSA", "DSA", "DH", "EC", "ECDSA", "ECDH", "ED25519", "ED448", "X25519", "X448", "ELGAMAL")


def hardcoded(literal: Column) -> Column:
    """A secret's literal: ``No`` (none, or a placeholder), ``Zero`` (all zeros) or ``Yes``."""
    bare = unquote(literal)
    return F.when(literal.isNull() | (bare == "") | F.lower(bare).rlike(r"^(none|null|changeme|xxx+|todo|<.*>|\$\{.*\}|\{\{.*\}\})$"), "No").when(bare.rlike(r"^(0|\\x00)+$"), "Zero").otherwise("Yes")


def date_after(date: Column, today: Column) -> Column:
    """Whether a date, as ``YYYY-MM-DD`` text, is past; text that is no date never is."""
    valid = date.rlike(r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$")
    return F.coalesce(valid & (date < today), F.lit(False))


def escaped(text: Column, kind: str) -> Column:
    """``xml``: markup signs as references; ``csv``: quoted where needed; ``dot``: quotes and breaks."""
    if kind == "xml":
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            text = F.replace(text, F.lit(a), F.lit(b))
        return text
    if kind == "csv":
        return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def finding_key(rule: Column, message: Column, line: Column) -> Column:
    """What a finding is known by over time: rule, message, and the source line without its spacing."""
    return F.sha2(F.concat_ws("\u0001", rule, message, F.trim(F.regexp_replace(line, r"\s+", " "))), 256)


def argument_at(arguments: DataFrame, n: int) -> DataFrame:
    """The ``n``-th positional argument of each call."""
    return arguments.where((F.col("pos") == n) & F.col("kw").isNull())
