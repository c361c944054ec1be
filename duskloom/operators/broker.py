"""Broker policy: which secret may resolve into which tool's parameter. Denied unless a rule says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.python import shell_split

# Tools that are never brokered, and the families whose host can be read from a value.
SHELLS = ("Bash", "bash", "sh", "shell", "Shell", "zsh", "fish", "dash", "ksh", "pwsh", "powershell", "PowerShell", "cmd", "Execute", "exec", "run_command")
AGENTS = ("Task", "Agent")
HTTP_TOOLS = ("curl", "wget", "http", "https", "httpie")
PSQL_TOOLS = ("psql", "pg_dump", "pg_restore", "pg_dumpall", "createdb", "dropdb")
MYSQL_TOOLS = ("mysql", "mariadb")
SSH_TOOLS = ("ssh", "scp", "sftp", "rsync")
SSH_VALUE_FLAGS = ("-i", "-p", "-l", "-o", "-F", "-c")


def like(text: Column, glob: Column) -> Column:
    """Whether a glob fits a text: '*' any characters, '?' one."""
    quoted = F.regexp_replace(glob, r"([.+^$()|\[\]{}\\])", r"\\$1")
    return F.rlike(text, F.concat(F.lit("^(?s:"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit(")$")))


def _url_host(value: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(value, r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^\s/@\"']*@)?([^\s/:?#\"']+)", 1)), F.lit(""))


def _after_flag(words: Column) -> Column:
    """The value of the first -h, --host or --host=."""
    places = F.transform(words, lambda w, i: F.when(w.startswith("--host="), F.substring(w, 8, 1000)).when(w.isin("-h", "--host"), F.get(words, i + 1)))
    return F.nullif(F.lower(F.get(F.filter(places, lambda x: x.isNotNull()), F.lit(0))), F.lit(""))


def _dsn_host(words: Column) -> Column:
    return F.lower(F.get(F.filter(F.transform(words, lambda w: F.nullif(F.regexp_extract(w, "^host=(.+)$", 1), F.lit(""))), lambda x: x.isNotNull()), F.lit(0)))


def _ssh_host(words: Column) -> Column:
    """The first bare word that no flag takes as its value, without user and path."""
    bare = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), F.coalesce(F.get(words, i - 1).isin(*SSH_VALUE_FLAGS), F.lit(False)).alias("taken"))), lambda x: ~x["taken"] & ~x["w"].startswith("-") & ~x["w"].isin(*SSH_TOOLS))
    first = F.get(bare, F.lit(0))["w"]
    return F.nullif(F.lower(F.split_part(F.element_at(F.split(first, "@"), -1), F.lit(":"), F.lit(1))), F.lit(""))


def destination(tool: Column, value: Column, words: Column) -> Column:
    """The host a tool's value leads to; null where none can be read. words: the value as a shell splits it."""
    url = _url_host(value)
    return (
        F.when(tool.isin(*HTTP_TOOLS), url).when(tool.isin(*PSQL_TOOLS), F.coalesce(url, _after_flag(words), _dsn_host(words)))
        .when(tool.isin(*MYSQL_TOOLS), F.coalesce(_after_flag(words), url)).when(tool.isin(*SSH_TOOLS), _ssh_host(words))
    )


def with_destination(calls: DataFrame) -> DataFrame:
    """calls (tool, value) with host."""
    return calls.withColumn("_words", shell_split("value")).withColumn("host", destination(F.col("tool"), F.col("value"), F.col("_words"))).drop("_words")


def decided(calls: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """calls (key, secret, tool, pointer, value) with decision. rules (rule_idx, secret_glob, tool_glob, param_glob, hosts): a small
    ordered list, held in an array beside each call; the first that fits decides."""
    listed = rules.agg(F.array_sort(F.collect_list(F.struct("rule_idx", "secret_glob", "tool_glob", "param_glob", "hosts"))).alias("_rules")).first()["_rules"]
    names = ("secret_glob", "tool_glob", "param_glob")
    literal = F.array(*[F.struct(*[F.lit(r[n]).alias(n) for n in names], (F.array(*map(F.lit, r["hosts"])) if r["hosts"] is not None else F.lit(None).cast("array<string>")).alias("hosts")) for r in listed]) if listed else None
    rows = with_destination(calls)
    tool = F.col("tool")
    if literal is None:
        found = F.lit("no_rule")
    else:
        fits = lambda r: (r["secret_glob"].isNull() | like(F.col("secret"), r["secret_glob"])) & like(tool, r["tool_glob"]) & like(F.col("pointer"), r["param_glob"])
        rule = F.get(F.filter(literal, fits), F.lit(0))
        hosts = rule["hosts"]
        found = F.when(rule.isNull(), "no_rule").when(hosts.isNull(), "resolve").when(F.col("host").isNull(), "host_unparsed").when(F.array_contains(F.transform(hosts, F.lower), F.col("host")), "resolve").otherwise("host_not_allowed")
    egress = tool.startswith("mcp__") | tool.startswith("subagent_") | tool.isin(*AGENTS)
    return rows.select(key, F.when(egress, "egress_boundary").when(tool.isin(*SHELLS), "opaque_command").otherwise(found).alias("decision"), "host")
