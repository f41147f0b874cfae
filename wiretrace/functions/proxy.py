"""Proxy settings as text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from . import jsvalue as js


@F.pandas_udf(StringType())
def _indented(compact: pd.Series) -> pd.Series:
    """Compact JSON with two-blank indentation (no built-in prints this form)."""
    return compact.map(lambda t: json.dumps(json.loads(t), indent=2, ensure_ascii=False), na_action="ignore")


def _server_list(value: Column) -> Column:
    """A server, or a list of servers: brackets only around more than one."""
    items = js.element_texts(value)
    text = F.array_join(items, ", ", "null")
    return F.when(items.isNull(), js.to_text(value)).when(
        F.size(items) > 1, F.concat(F.lit("["), text, F.lit("]"))
    ).otherwise(text)


def _numbered(mode: Column, position: Column) -> Column:
    """A mode's lines under "(n) ", later lines indented to match."""
    start = F.concat(F.lit("("), (position + 1).cast("string"), F.lit(") "))
    indent = F.concat(F.lit("\n"), F.repeat(F.lit(" "), F.length(start)))
    return F.concat(start, F.call_function("array_join", mode, indent))


def proxy_config_text(config: Column) -> Column:
    """Ordered text of a proxy settings object; "" when it is no object."""
    none = F.array().cast("array<string>")
    rules = js.field(config, "override_rules")
    override = F.when(
        js.truthy(rules),
        F.concat(F.array(F.lit("Override rules:")), F.split(_indented(F.to_json(rules)), "\n")),
    )
    detect = F.when(js.truthy(js.field(config, "auto_detect")), F.array(F.lit("Auto-detect")))
    pac = js.field(config, "pac_url")
    script = F.when(js.truthy(pac), F.array(F.concat(F.lit("PAC script: "), js.to_text(pac))))

    single, schemes = js.field(config, "single_proxy"), js.field(config, "proxy_per_scheme")
    entries = F.map_entries(F.try_variant_get(schemes, "$", "map<string,variant>"))
    per_scheme = F.transform(
        F.filter(entries, lambda e: e["key"] != "fallback"),
        lambda e: F.concat(F.lit("Proxy server for "), F.upper(e["key"]), F.lit(": "), _server_list(e["value"])),
    )
    fallback = js.field(schemes, "fallback")
    rest = F.when(
        js.truthy(fallback), F.array(F.concat(F.lit("Proxy server for everything else: "), _server_list(fallback)))
    )
    servers = F.when(
        js.truthy(single), F.array(F.concat(F.lit("Proxy server: "), _server_list(single)))
    ).otherwise(F.concat(F.coalesce(per_scheme, none), F.coalesce(rest, none)))
    bypass = js.element_texts(js.field(config, "bypass_list"))
    title = F.when(js.truthy(js.field(config, "reverse_bypass")), F.lit("Reversed bypass list: ")).otherwise(
        F.lit("Bypass list: ")
    )
    skipped = F.concat(F.array(title), F.transform(bypass, lambda b: F.concat(F.lit("  "), b)))
    manual = F.when(
        js.truthy(single) | js.truthy(schemes), F.concat(servers, F.coalesce(skipped, none))
    )

    modes = F.array_compact(F.array(override, detect, script, manual))
    # bound as a lambda variable, so the long expression is evaluated once
    body = F.get(
        F.transform(
            F.array(modes),
            lambda m: F.when(F.size(m) == 0, F.lit("Use DIRECT connections."))
            .when(F.size(m) == 1, F.array_join(F.get(m, F.lit(0)), "\n"))
            .otherwise(F.array_join(F.transform(m, _numbered), "\n")),
        ),
        F.lit(0),
    )
    source = js.as_string(js.field(config, "source"))
    origin = F.when(source != "UNKNOWN", F.concat(F.lit("\nSource: "), source)).otherwise(F.lit(""))
    return F.when(js.is_object(config), F.concat(body, F.coalesce(origin, F.lit("")))).otherwise(F.lit(""))
