"""What files other than code give away: keys, keystores, secrets, weak settings. DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import key_issue, weak_word

KEYSTORES = ("jks", "jceks", "keystore", "p12", "pfx", "bks", "kdb")
#: Words of an algorithm's constants, as hexadecimal text (S13f).
CONSTANTS = {
    "MD5": ["d76aa478", "e8c7b756", "242070db", "c1bdceee"],
    "SHA-1": ["5a827999", "6ed9eba1", "8f1bbcdc", "ca62c1d6"],
    "SHA-256": ["428a2f98", "71374491", "b5c0fbcf", "e9b5dba5"],
    "SHA-512": ["428a2f98d728ae22", "7137449123ef65cd", "b5c0fbcfec4d3b2f"],
    "ChaCha20": ["61707865", "3320646e", "79622d32", "6b206574"],
    "Blowfish": ["243f6a88", "85a308d3", "13198a2e", "03707344"],
    "CRC-32": ["77073096", "ee0e612c", "990951ba", "076dc419"],
    "TEA": ["9e3779b9", "c6ef3720"],
}
_SWITCHES = {
    "certificates are not checked": r"verify\s*=\s*False|CERT_NONE|InsecureSkipVerify\s*:\s*true|rejectUnauthorized\s*:\s*false|check_hostname\s*=\s*False|VERIFY_NONE|CURLOPT_SSL_VERIFYPEER\s*,\s*(0|false)|NODE_TLS_REJECT_UNAUTHORIZED|_create_unverified_context|danger_accept_invalid_certs\(true\)|ServerCertificateValidationCallback|TrustAllCerts|ALLOW_ALL_HOSTNAME_VERIFIER|\bcurl\b.*\s(-k|--insecure)\b|wget\s.*--no-check-certificate",
    "old protocol": r"PROTOCOL_SSLv[23]|PROTOCOL_TLSv1(_1)?\b|MinVersion\s*:\s*tls\.Version(SSL30|TLS10|TLS11)|SslProtocols\.(Ssl2|Ssl3|Tls|Tls11)\b|SSLv3_method|TLSv1_method",
}


def _lines(files: DataFrame) -> DataFrame:
    """file, line, code of the texts of up to 1 MB."""
    return files.where(F.octet_length("text") <= 1 << 20).select(F.col("path").alias("file"), F.posexplode(F.split("text", "\r?\n")).alias("at", "code")).select("file", (F.col("at") + 1).alias("line"), "code")


def _use(df: DataFrame, name: Column, algorithm: Column, issue: Column) -> DataFrame:
    return df.select("file", F.col("line").cast("int").alias("line"), name.alias("name"), algorithm.alias("algorithm"), issue.alias("issue"))


def keystores(files: DataFrame) -> DataFrame:
    """Keystores by extension."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return _use(files.where(ext.isin(*KEYSTORES)).select(F.col("path").alias("file"), F.lit(1).alias("line")), F.lit("keystore"), F.lit(None).cast("string"), F.lit("hardcoded keystore"))


def der_files(files: DataFrame) -> DataFrame:
    """S13h: files (path, content) of a key's or certificate's extension that begin as DER does."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    own = files.where(ext.isin("der", "crt", "cer", "key", "p8", "pk8") & (F.hex(F.substring("content", 1, 1)) == "30")).select(F.col("path").alias("file"), F.lit(1).alias("line"), ext.alias("ext"))
    private = F.col("ext").isin("key", "p8", "pk8")
    return _use(own, F.when(private, "private key").otherwise("certificate"), F.lit(None).cast("string"), F.when(private, "private key in a file"))


def pem_blocks(files: DataFrame) -> DataFrame:
    """S13i: PEM headers with base64 behind them; private ones are an issue. On the same or the next line."""
    body = r"-----BEGIN ([A-Z0-9 ]+)-----(?:\s*\\n|\s)*(?:[A-Za-z0-9+/=]{20}|Proc-Type|Version|Comment)"
    text = F.col("text")
    own = files.where(text.contains("-----BEGIN ")).select(F.col("path").alias("file"), F.split("text", "\n").alias("lines"))
    own = own.select("file", "lines", F.posexplode("lines").alias("at", "code")).where(F.col("code").contains("-----BEGIN "))
    two = F.concat_ws("\n", "code", F.try_element_at("lines", F.col("at") + 2))
    kind = F.regexp_extract(two, body, 1)
    hit = own.withColumn("kind", kind).where("kind != ''").withColumn("line", F.col("at") + 1)
    alg = F.when(F.col("kind").startswith("RSA"), "RSA").when(F.col("kind").startswith("EC"), "EC").when(F.col("kind").startswith("DSA"), "DSA")
    return _use(hit, F.lower("kind"), alg, F.when(F.col("kind").contains("PRIVATE"), "private key in source"))


def base64_keys(files: DataFrame) -> DataFrame:
    """S13j: DER as one line of base64: ``MI`` and 98 more characters, not inside a word."""
    own = _lines(files).where(F.col("code").rlike(r"(?<![A-Za-z0-9+/])MI[A-Za-z0-9+/]{98,}={0,2}(?![A-Za-z0-9+/])"))
    return _use(own, F.lit("base64 DER"), F.lit(None).cast("string"), F.lit("key or certificate in source"))


def jwk_keys(files: DataFrame) -> DataFrame:
    """S13k: JSON web keys: algorithm, bits of ``n`` or ``k``, private where ``d`` or ``k`` is there."""
    own = files.where(F.col("text").rlike(r'"kty"\s*:'))
    each = own.select(F.col("path").alias("file"), F.explode(F.regexp_extract_all("text", F.lit(r'(\{[^{}]*"kty"[^{}]*\})'), F.lit(1))).alias("j"))
    part = lambda n: F.get_json_object("j", f"$.{n}")
    value = F.when(part("kty") == "oct", part("k")).otherwise(part("n"))
    bits = (F.floor(F.length(F.regexp_replace(value, "=", "")) * 6 / 8) * 8).cast("int")
    private = part("d").isNotNull() | (part("kty") == "oct")
    alg = F.when(part("kty") == "oct", "HMAC").otherwise(part("kty"))
    issue = F.concat_ws("; ", F.when(private, "private key in a file"), key_issue(alg, bits))
    return _use(each.withColumn("line", F.lit(1)), F.lit("jwk"), alg, F.when(issue != "", issue))


def tls_switches(files: DataFrame) -> DataFrame:
    """S13l: switches that turn checks off or allow old protocols; comment lines don't count, the first hit of a line does."""
    own = _lines(files).where(~F.col("code").rlike(r"^\s*(#|//|/\*|\*|--|;)"))
    issue = F.coalesce(*[F.when(F.col("code").rlike(p), n) for n, p in _SWITCHES.items()])
    return _use(own.withColumn("issue_", issue).where("issue_ IS NOT NULL"), F.lit("tls"), F.lit(None).cast("string"), F.col("issue_"))


def settings(files: DataFrame) -> DataFrame:
    """S13q: ``file``, ``line``, ``key``, ``value`` of ``key value``, ``key = value`` and ``key: value`` lines.

    In toml, ini, cfg and cnf files a ``[section]`` goes before the keys below it.
    """
    own = _lines(files).where(~F.col("code").rlike(r"^\s*([#;!]|//|$)"))
    from pyspark.sql.window import Window

    sections = F.col("file").rlike(r"\.(toml|ini|cfg|cnf)$")
    section = F.last(F.when(sections, F.nullif(F.regexp_extract("code", r"^\s*\[+\s*([^\]]+?)\s*\]+\s*$", 1), F.lit(""))), ignorenulls=True).over(Window.partitionBy("file").orderBy("line"))
    own = own.withColumn("section", section).where(~F.col("code").rlike(r"^\s*\["))
    key = F.regexp_extract("code", r"^\s*[\"']?([A-Za-z0-9_.$-]+)[\"']?\s*(?:[:=]|\s)\s*(.+?)\s*[,;]?\s*$", 1)
    value = F.regexp_extract("code", r"^\s*[\"']?([A-Za-z0-9_.$-]+)[\"']?\s*(?:[:=]|\s)\s*(.+?)\s*[,;]?\s*$", 2)
    return own.select("file", "line", F.concat_ws(".", "section", key).alias("key"), F.regexp_replace(value, "^[\"'](.*)[\"']$", "$1").alias("value")).where("value != ''")


def weak_settings(files: DataFrame) -> DataFrame:
    """S13m: settings about ciphers and protocols whose value names a weak one; lists of what is denied don't count."""
    s = settings(files)
    about = F.lower("key").rlike(r"cipher|ssl|tls|protocol|kex|macs|hash|digest|signature|algorithm") & ~F.lower("key").rlike(r"disabled|deny|exclude|blacklist|reject")
    weak = weak_word(F.col("value"))
    old = F.lower("key").rlike(r"(tls|ssl).*(min|version)") & F.col("value").isin("1.0", "1.1", "1", "TLS1.0", "TLS1.1")
    hit = s.where(about).withColumn("weak", F.coalesce(weak, F.when(old, F.concat(F.lit("TLS "), "value")))).where("weak IS NOT NULL")
    return _use(hit, F.col("key"), F.col("weak"), F.lit("weak setting"))


def script_keys(files: DataFrame) -> DataFrame:
    """S13s: keys made too short in scripts: ``genrsa N``, ``rsa:N``, ``-b N``, ``-keysize N`` with 256 to 2047 bits."""
    n = F.regexp_extract("code", r"(?:genrsa\s+(?:\S+\s+)*?|rsa:|ssh-keygen\b.*\s-b\s+|-keysize\s+)(\d{3,5})", 1)
    hit = _lines(files).withColumn("bits", F.try_to_number(n, F.lit("99999")).cast("int")).where("bits >= 256 AND bits < 2048")
    return _use(hit, F.lit("key generation"), F.lit("RSA"), key_issue(F.lit("RSA"), F.col("bits")))


def constants(files: DataFrame) -> DataFrame:
    """S13f: algorithms all of whose words a text holds as numbers; one row for each."""
    low = F.lower(F.regexp_replace("text", "_", ""))
    table = F.array(*[F.struct(F.lit(a).alias("algorithm"), F.array(*[F.lit(w) for w in ws]).alias("words")) for a, ws in CONSTANTS.items()])
    own = files.select(F.col("path").alias("file"), F.regexp_extract_all(low, F.lit(r"0x([0-9a-f]{6,16})"), F.lit(1)).alias("numbers"))
    padded = F.transform("numbers", lambda x: F.lpad(x, 8, "0") if x is not None else x)
    own = own.withColumn("numbers", F.when(F.size("numbers") > 0, F.transform("numbers", lambda x: F.when(F.length(x) < 8, F.lpad(x, 8, "0")).otherwise(x))).otherwise(padded))
    hit = own.select("file", "numbers", F.explode(table).alias("t")).where(F.size(F.array_except("t.words", "numbers")) == 0)
    weak = F.col("t.algorithm").isin("MD5", "SHA-1")
    return _use(hit.withColumn("line", F.lit(1)), F.lit("constants"), F.col("t.algorithm"), F.when(weak, "weak algorithm"))


def scan(files: DataFrame) -> DataFrame:
    """All detectors over texts (path, text), one row a file, line, name and algorithm."""
    out = keystores(files)
    for part in (pem_blocks, base64_keys, jwk_keys, tls_switches, weak_settings, script_keys, constants):
        out = out.unionByName(part(files))
    return out.dropDuplicates(["file", "line", "name", "algorithm"])


def flagged(uses: DataFrame) -> DataFrame:
    """Uses that have an issue."""
    return uses.where("issue IS NOT NULL")


def bill_of_materials(uses: DataFrame) -> DataFrame:
    """Uses grouped by name and algorithm: how many, where first."""
    return uses.groupBy("name", "algorithm").agg(F.count("*").alias("uses"), F.min(F.concat_ws(":", "file", F.col("line").cast("string"))).alias("first"))
