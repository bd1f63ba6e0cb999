"""Gateway and Apache log lines: parsing, masks, signature families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Formats of lines, signatures of families, masks; Java's regular expressions with ASCII classes.
GATEWAY = r'^(\S+) - (\S+) \[([^\]]+)\] "([A-Z]+) (.*?) HTTP/1\.1" (\d{3}) (\d+) (\d+)ms "(.*)"$'
APACHE = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\d+|-)(?: "([^"]*)" "([^"]*)")?'
TRAVERSAL = r"(?i)(\.\./|\.\.%2f|%2e%2e)"
SQLI = r"(?i)('|%27|;|%3b|--|\bunion[\s+]+select\b|\bdrop[\s+]+table\b)"
SCANNER = r"(?i)(^/\.|/\.git\b|\.php\b|/phpmyadmin|/actuator/|^/wp-)"
SCANNER_NO_PHP = r"(?i)(^/\.|/\.git\b|/phpmyadmin|/actuator/|^/wp-)"
#: Paths of words joined by single hyphens, none of which begins like one of SCANNER: no signature can stand in them.
PLAIN = r"\A(?:/(?!(?i:phpmyadmin|actuator|wp-))\w++(?:-\w++)*+)++\z"
BALANCE = r"^/api/v1/accounts/[^/?]+/balance$"
STATUS = r"^/api/v1/transactions/[^/?]+/status$"
SETTLEMENT = r"^/api/v1/settlements/\w+$"
ROUTE = "/api/v1/transactions/route"
MASKS = (
    (r"\b(?:merchant|wallet-user|bank)-\d+\b", "<ENTITY>"),
    (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "<IP>"),
    (r"\b[0-9a-f]{8,}\b", "<HEX>"),
    (r"\b\d+\b", "<NUM>"),
)
#: What hardly any line holds.
BETWEEN = "\x01"
BENIGN = ("route", "declined", "balance", "status", "settlement")
SIGNATURES = ("sqli_probe", "path_traversal", "scanner_probe")


def parse(df: DataFrame, line: str = "log_message") -> DataFrame:
    """Lines that are gateway lines, with their eight parts; the others go.

    The pattern is matched once a line: its parts are joined by a character that the line does not hold, and split there.
    A line that does hold it, or that ends otherwise, is matched once for each part.
    """
    c, used = F.col(line), (1, 2, 4, 5, 6, 7, 8, 9)
    once = F.split(F.regexp_replace(c, GATEWAY, BETWEEN.join(f"${i}" for i in used)), BETWEEN)
    each = F.when(c.rlike(GATEWAY), F.array(*[F.regexp_extract(c, GATEWAY, i) for i in used]))
    found = F.when(c.endswith('"') & ~F.contains(c, F.lit(BETWEEN)), once).otherwise(each)
    part = lambda i: F.col("_parts")[used.index(i)]
    # exploded, as a filter below would have the pattern matched again; a lambda in the array would be interpreted
    rows = df.withColumn("_parts", F.explode(F.array(found))).filter(F.size("_parts") == len(used))
    return rows.withColumns(
        {
            "log_ip": part(1),
            "log_payer": F.nullif(part(2), F.lit("-")),
            "method": part(4),
            "path": part(5),
            "code": part(6).try_cast("int"),
            "nbytes": part(7).try_cast("long"),
            "latency": part(8).try_cast("long"),
            "msg": part(9),
        }
    ).drop("_parts")


def parse_apache(df: DataFrame, line: str = "value") -> DataFrame:
    """Combined-format lines with request, code and time; the others go."""
    c = F.col(line)
    part = lambda i: F.regexp_extract(c, APACHE, i)
    request = part(5)
    return df.filter(c.rlike(APACHE)).withColumns(
        {
            "ip": part(1),
            "t": F.unix_timestamp(part(4), "dd/MMM/yyyy:HH:mm:ss Z"),
            "method": F.substring_index(request, " ", 1),
            "path": F.regexp_extract(request, r"^\S+ (.*?)(?: HTTP/[\d.]+)?$", 1),
            "code": part(6).try_cast("int"),
            "nbytes": F.coalesce(F.expr(f"try_cast(regexp_extract({line}, '{APACHE.replace(chr(92), chr(92) * 2)}', 7) as long)"), F.lit(0)),
        }
    )


def content() -> Column:
    """What templates are mined from."""
    method, path, code, msg = (F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("method", "path", "code", "msg"))
    return F.concat(method, F.lit(" "), path, F.lit(" "), code, F.lit(' "'), msg, F.lit('"'))


def masked(c: Column) -> Column:
    """Variable parts replaced, in this order."""
    for pattern, mask in MASKS:
        c = F.regexp_replace(c, pattern, mask)
    return c


def family(scanner: str = SCANNER) -> Column:
    """F7; ``scanner`` is the signature to use, which an ablation swaps (M9).

    Most paths are ``PLAIN`` and are not looked through for signatures; benign routes are matched where their first part stands.
    """
    path, code = F.col("path"), F.col("code")
    signed = F.when(path.rlike(TRAVERSAL), "path_traversal").when(path.rlike(SQLI), "sqli_probe")
    if scanner in (SCANNER, SCANNER_NO_PHP):
        signed = F.when(~path.rlike(PLAIN), signed.when(path.rlike(scanner), "scanner_probe"))
    else:
        signed = F.coalesce(F.when(~path.rlike(PLAIN), signed), F.when(path.rlike(scanner), "scanner_probe"))
    route = lambda first, pattern: path.startswith(first) & path.rlike(pattern)
    other = (
        F.when((code == 401) | F.col("msg").startswith("authentication failed"), "auth_failure")
        .when((path == ROUTE) & (code == 402), "declined")
        .when((path == ROUTE) & (code == 400), "schema_reject")
        .when(path == ROUTE, "route")
        .when(route("/api/v1/accounts/", BALANCE), "balance")
        .when(route("/api/v1/transactions/", STATUS), "status")
        .when(route("/api/v1/settlements/", SETTLEMENT), "settlement")
        .otherwise("other")
    )
    return F.coalesce(signed, other)


def level(fam: Column) -> Column:
    return (
        F.when(fam.isin(*SIGNATURES), 2)
        .when((fam == "auth_failure") | ((fam == "other") & (F.col("code") >= 400)), 1)
        .otherwise(0)
    )


def attempt() -> Column:
    """Attempt number in a failed login's message, 0 if none."""
    return F.coalesce(F.nullif(F.regexp_extract("msg", r"\(attempt (\d+)\)", 1), F.lit("")).cast("int"), F.lit(0))


def label_groups(labels: Column) -> Column:
    """Tags of a label line without the benign one, variants grouped."""
    tags = F.transform(F.split(labels, ","), lambda t: F.trim(t))
    grouped = F.transform(tags, lambda t: F.when(t.startswith("webshell"), "webshell").when(t.startswith("mail-curl"), "mail-curl").otherwise(t))
    return F.array_sort(F.array_distinct(F.filter(grouped, lambda t: (t != "0") & (t != ""))))
