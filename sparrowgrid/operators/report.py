"""Daily report: metrics of a NAV history as one row, and a page of HTML made from it."""

from __future__ import annotations

from email.message import EmailMessage

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import metrics as M


def metrics(nav: DataFrame) -> DataFrame:
    """One row from (dt, nav): the last NAV, gains of the day, of seven days and since inception,
    ratios, drawdown and the 5 % quantile of returns. A single day gains 0; no days: nulls."""
    order = W.orderBy("dt")  # one row a day
    days = nav.withColumns({"before": F.lag("nav").over(order), "last": F.max("dt").over(W.partitionBy())})
    days = days.withColumns({"ret": F.col("nav") / F.col("before") - 1, "all": F.lit(1)})
    week = F.when(F.col("dt") >= F.date_sub("last", 7), F.col("dt"))
    gains = days.agg(
        F.max("dt").alias("dt"), F.max_by("nav", "dt").alias("nav"), F.coalesce(F.max_by(F.col("nav") - F.col("before"), "dt"), F.lit(0.0)).alias("pnl_day"),
        (F.max_by("nav", week) - F.min_by("nav", week)).alias("pnl_week"), (F.max_by("nav", "dt") - F.min_by("nav", "dt")).alias("pnl_inception"),
        F.percentile("ret", F.lit(0.05)).alias("var_95"),
    )
    ratios = M.summary(days.where("ret is not null"), "all").select("sharpe", "sortino", "calmar", "max_drawdown")
    return gains.join(F.broadcast(ratios), F.lit(True), "left")  # one row


def curve(nav: list[tuple], width: int = 720, height: int = 200) -> str:
    """The NAV path as an inline SVG line."""
    values = [v for _, v in nav]
    low, span = min(values), (max(values) - min(values)) or 1.0
    step = width / max(1, len(values) - 1)
    points = " ".join(f"{i * step:.1f},{height - (v - low) / span * height:.1f}" for i, v in enumerate(values))
    return f'<svg viewBox="0 0 {width} {height}" role="img" aria-label="NAV"><polyline fill="none" stroke="currentColor" points="{points}"/></svg>'


def html(nav: DataFrame, orders: DataFrame | None = None, regime: str | None = None) -> str:
    """The report as a self-contained page. What reaches the driver is a row a day of the
    history and the orders of the latest date."""
    path = [(r.dt, r.nav) for r in nav.orderBy("dt").select("dt", "nav").collect()]
    if not path:
        return "<!doctype html><title>Report</title><p>No history.</p>"
    row = metrics(nav).first().asDict()
    cells = "".join(f"<tr><th>{escape(k)}</th><td>{v if not isinstance(v, float) else format(v, ',.4f')}</td></tr>" for k, v in row.items())
    made = ""
    if orders is not None:
        last = orders.agg(F.max("dt").alias("dt"))
        rows = orders.join(F.broadcast(last), "dt").orderBy("asset").collect()  # one row
        made = "".join(f"<tr><td>{escape(str(r.asset))}</td><td>{r.old_w:.4f}</td><td>{r.new_w:.4f}</td></tr>" for r in rows)
        made = f"<table><tr><th>asset</th><th>from</th><th>to</th></tr>{made}</table>"
    head = f"<p>Regime: {escape(regime)}</p>" if regime else ""
    return f"<!doctype html><meta charset='utf-8'><title>Report {row['dt']}</title>{head}<table>{cells}</table>{curve(path)}{made}"


def send(html: str, subject: str, recipients: list[str], sender: str, transport) -> bool:
    """Hand a report to ``transport``, a callable that takes an email message; without recipients nothing is sent."""
    if not recipients:
        return False
    message = EmailMessage()
    message["Subject"], message["From"], message["To"] = subject, sender, ", ".join(recipients)
    message.set_content("This report needs a reader that shows HTML.")
    message.add_alternative(html, subtype="html")
    transport(message)
    return True
