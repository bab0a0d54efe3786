"""Response and error classification as ordered CASE expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Markers by which responses are told apart.
RATE_MARKERS = ("error 1015", "error code: 1015", "you are being rate limited")
CHALLENGE_MARKERS = ("just a moment", "checking your browser", "verifying you are human", "verify you are human", "cf-browser-verification", "cf-chl-")
DENIED_MARKERS = ("sorry, you have been blocked", "used cloudflare to restrict access", "cf-error-details", "error code: 10", "access denied")
CDN_TITLES = ("just a moment", "attention required", "access denied", "cloudflare")
CHALLENGE_PAGE = ("cf-browser-verification", "challenge-platform", "checking your browser", "verifying you are human", "ddos protection by cloudflare", "ray id:", "cf-error", "cf-chl-bypass")

# Markers of errors at an exit, of passing network errors, of blocking.
EXIT_ERRORS = (
    "err_proxy_connection_failed", "err_tunnel_connection_failed", "err_socks_connection_failed", "err_socks_connection_host_unreachable",
    "err_proxy_auth_unsupported", "err_proxy_auth_requested", "err_proxy_certificate_invalid", "err_mandatory_proxy_configuration_failed",
    "err_no_supported_proxies", "proxy authentication required", "proxy connection",
)
PASSING_ERRORS = (
    "err_network_access_denied", "err_network_changed", "err_network_io_suspended", "err_internet_disconnected", "err_name_not_resolved",
    "err_connection_refused", "err_connection_reset", "err_connection_closed", "err_connection_aborted", "err_connection_timed_out",
    "err_connection_failed", "err_timed_out", "err_address_unreachable", "err_empty_response", "err_http2_protocol_error",
    "err_quic_protocol_error", "err_ssl_protocol_error", "err_aborted", "econnreset", "econnrefused", "econnaborted", "etimedout",
    "enotfound", "ehostunreach", "enetunreach", "eai_again", "socket hang up",
)
BLOCKING_CODES = ("522", "523", "524", "525", "502", "503", "504", "429")
BLOCKING_MARKERS = ("net::err_aborted", "net::err_connection_reset", "net::err_connection_closed", "net::err_timed_out", "err_http_response_code_failure")

# What a login page shows.
LOGIN_URLS = ("/login.action", "loginpage", "/dologin")
LOGIN_TITLES = ("log in", "login", "sign in", "entrar")

# Resource types whose loss spoils a page, and failures that do not count.
CONTENT_TYPES = ("image", "stylesheet", "font", "media")
IGNORED_FAILURES = ("err_aborted", "err_blocked_by_client", "err_cache_miss")

MAX_RETRY_AFTER = 24 * 3600.0


def any_of(c: Column, markers: tuple[str, ...]) -> Column:
    return c.rlike("|".join(map(re.escape, markers)))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds of a Retry-After header (number or HTTP date, seen at epoch second ``now``); null if unusable.

    Only values that are no number travel to Python, for a date in any of its forms.
    """
    t = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    number = t.try_cast("double")
    s = F.coalesce(number, http_date_seconds(F.when(number.isNull() & (t != ""), t)) - now)
    return F.when((t != "") & s.between(0, MAX_RETRY_AFTER), s)


def listing_status(status: Column, is_root: Column) -> Column:
    """What the status of a page says about its children: none (404 or 410 below the root), failed, or read them."""
    return F.when(status.isin(404, 410) & ~is_root, "no children").when(status >= 400, "failed").otherwise("read")


def response_kind(status: Column, mitigated: Column, title: Column, body: Column, is_page: Column) -> Column:
    """rate-limit, challenge, server-error, access-denied, or null for no block."""
    t = F.lower(F.coalesce(title, F.lit("")))
    text = F.concat(t, F.lit("\n"), F.lower(F.coalesce(body, F.lit(""))))
    ok = F.coalesce(status.between(200, 299), F.lit(False))
    none = F.lit(None).cast("string")
    return (
        F.when(status == 429, "rate-limit")
        .when(F.lower(F.coalesce(mitigated, F.lit(""))) == "challenge", "challenge")
        .when(ok & F.coalesce(is_page, F.lit(False)), none)
        .when(ok & ~any_of(t, CDN_TITLES), none)
        .when(any_of(text, RATE_MARKERS), "rate-limit")
        .when(any_of(text, CHALLENGE_MARKERS), "challenge")
        .when(status >= 500, "server-error")
        .when(F.contains(text, F.lit("cloudflare")) & any_of(text, DENIED_MARKERS), "access-denied")
    )


def page_kind(status: Column, mitigated: Column, title: Column, body: Column, is_page: Column) -> Column:
    """The same for a browser page, of whose body the first 20,000 characters count."""
    return response_kind(status, mitigated, title, F.substring(body, 1, 20_000), is_page)


def headline(error: Column) -> Column:
    return F.lower(F.regexp_replace(F.substring_index(error, "\nCall log:", 1), r"https?://\S+", "<url>"))


def short_error(error: Column, limit: int = 300) -> Column:
    t = F.regexp_replace(F.substring_index(error, "\nCall log:", 1), r"(?U)^\s+|\s+$", "")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 3), F.lit("...")))


def is_blocking(error: Column) -> Column:
    return any_of(headline(error), BLOCKING_MARKERS) | headline(error).rlike(rf"(?<!\d)({'|'.join(BLOCKING_CODES)})(?!\d)")


def is_exit_error(error: Column) -> Column:
    return any_of(headline(error), EXIT_ERRORS)


def is_passing(error: Column) -> Column:
    return any_of(headline(error), EXIT_ERRORS + PASSING_ERRORS)


def is_challenge_page(content: Column) -> Column:
    return any_of(F.lower(content), CHALLENGE_PAGE)


def login_score(url: Column, has_form: Column, title: Column) -> Column:
    """Points for a login page; two or more make one. A strong sign ends the count."""
    by_url = F.when(any_of(F.lower(F.coalesce(url, F.lit(""))), LOGIN_URLS), 2).otherwise(0)
    by_form = F.when((by_url < 2) & has_form, 2).otherwise(0)
    by_title = F.when((by_url + by_form < 2) & any_of(F.lower(F.coalesce(title, F.lit(""))), LOGIN_TITLES), 1).otherwise(0)
    return by_url + by_form + by_title


def asset_verdict(n_limited: Column, n_server: Column, n_dropped: Column, lenient: Column) -> Column:
    """blocked, transient or ok from a page's resource counts."""
    return F.when(n_limited > 0, "blocked").when((n_server + n_dropped > 0) & ~lenient, "transient").otherwise("ok")


def asset_verdicts(events: DataFrame, key: str = "nav_id") -> DataFrame:
    """events(key, status, dropped, lenient) of a page's resources -> (key, n_limited, n_server, n_dropped, statuses,
    verdict): bad statuses each once, in order, joined by a slash."""
    bad = (F.col("status") == 429) | (F.col("status") >= 500)
    n = events.groupBy(key).agg(
        F.count_if(F.col("status") == 429).alias("n_limited"), F.count_if(F.col("status") >= 500).alias("n_server"), F.count_if(F.coalesce("dropped", F.lit(False))).alias("n_dropped"),
        F.array_join(F.transform(F.sort_array(F.collect_set(F.when(bad, F.col("status")))), lambda s: s.cast("string")), "/").alias("statuses"), F.bool_or("lenient").alias("lenient"),
    )
    return n.select(key, "n_limited", "n_server", "n_dropped", "statuses", asset_verdict(F.col("n_limited"), F.col("n_server"), F.col("n_dropped"), F.coalesce("lenient", F.lit(False))).alias("verdict"))


# Words by which errors are advised on.
WAIT_WORDS, BROWSER_WORDS, DISK_WORDS, DENIED_WORDS = ("522", "523", "524", "429", "cloudflare"), ("playwright", "chromium", "browser"), ("disk", "space"), ("permission", "denied", "winerror 5")


def advice(error: Column) -> Column:
    """Which remedy fits an error: wait, browser, disk, permission or none."""
    e = F.lower(error)
    return F.when(any_of(e, WAIT_WORDS), "wait").when(any_of(e, BROWSER_WORDS), "browser").when(any_of(e, DISK_WORDS), "disk").when(any_of(e, DENIED_WORDS), "permission")


def resume_mode(force_recrawl: Column, force_reexport: Column) -> Column:
    return F.when(force_reexport, "regenerate").when(force_recrawl, "update").otherwise("auto")


@F.pandas_udf(T.DoubleType())
def http_date_seconds(s: pd.Series) -> pd.Series:
    """Epoch seconds of an HTTP date in any of its three forms; one without a zone is in UTC."""
    from datetime import timezone
    from email.utils import parsedate_to_datetime

    def one(v):
        try:
            t = parsedate_to_datetime(v) if v else None
            return None if t is None else (t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp()
        except (TypeError, ValueError, IndexError):
            return None

    return s.map(one).astype("float64")
