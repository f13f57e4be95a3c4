"""Deny rules for e-mail addresses as a table (O-E1).

A rule is (kind, text): ``domain`` denies the addresses of a domain and of every
domain below it, ``mailbox`` those with this part before the '@'. Every domain
is looked up with all the domains above it, itself included, so a rule meets its
domains in an equi-join, however many rules there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webreach.functions import patterns as P
from webreach.functions.urls import col, nstruct, py_strip

RULES_SCHEMA = "kind string, text string"


def default_rules(spark: SparkSession) -> DataFrame:
    """Placeholder domains, file endings (the top level of what looks like a
    domain) and placeholder mailboxes."""
    return spark.createDataFrame(
        [("domain", d) for d in P.DENY_EMAIL_DOMAINS] + [("domain", s.lstrip(".")) for s in P.DENY_EMAIL_SUFFIXES]
        + [("mailbox", m) for m in P.DENY_EMAIL_MAILBOXES], RULES_SCHEMA)


def domain_of(c) -> Column:
    return F.substring_index(F.lower(py_strip(col(c))), "@", -1)


def mailbox_of(c) -> Column:
    return F.substring_index(F.lower(py_strip(col(c))), "@", 1)


def and_above(domain: Column) -> Column:
    """array<string>: the domain and all above it, nearest first."""
    labels = F.split(domain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def denied(values: DataFrame, rules: DataFrame) -> DataFrame:
    """(value) -> (value, rule): the denied values, once each, with the rule that
    denies them as kind:text: the nearest domain, else the mailbox.

    Case and white space around values and rules don't count, null values are
    not denied, null and empty rules deny nothing, repeated rules are one."""
    rules = rules.select(F.lower(py_strip("kind")).alias("kind"), F.lower(py_strip("text")).alias("text")).filter("text <> ''").distinct()
    values = values.select("value").filter("value is not null").distinct()
    # rules are looked up for distinct domains: a domain of many addresses is one row here
    asked = (values.select(domain_of("value").alias("domain")).distinct()
             .select("domain", F.posexplode(and_above(F.col("domain"))).alias("far", "text")))
    of_domain = (asked.join(rules.filter("kind = 'domain'").select("text"), "text")
                 .groupBy("domain").agg(F.min(nstruct(far=F.col("far"), text=F.col("text"))).alias("d")).select("domain", F.col("d.text").alias("above")))
    of_mailbox = rules.filter("kind = 'mailbox'").select(F.col("text").alias("mailbox"), F.lit(True).alias("is_mailbox"))
    keyed = values.select("value", domain_of("value").alias("domain"), mailbox_of("value").alias("mailbox"))
    both = keyed.join(of_domain, "domain", "left").join(of_mailbox, "mailbox", "left").filter("above is not null or is_mailbox")
    return both.select("value", F.coalesce(F.concat(F.lit("domain:"), F.col("above")), F.concat(F.lit("mailbox:"), F.col("mailbox"))).alias("rule"))


def judged(values: DataFrame, rules: DataFrame) -> DataFrame:
    """All rows and columns of ``values`` (with ``value``), and the denying ``rule`` (null: none)."""
    return values.join(denied(values, rules), "value", "left")


def without_denied(contacts: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, emails, ...) with the e-mails that no rule denies."""
    values = contacts.select("url", F.explode("emails").alias("value"))
    bad = values.join(denied(values, rules), "value").groupBy("url").agg(F.collect_set("value").alias("_denied"))
    kept = F.array_except("emails", F.coalesce("_denied", F.array().cast("array<string>")))
    return contacts.join(bad, "url", "left").withColumn("emails", kept).select(*contacts.columns)
