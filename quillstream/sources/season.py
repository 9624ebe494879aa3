"""A small season of landing files with the mess that real ones have, for tests and trials. All of it is invented."""

from __future__ import annotations

import json
import random
import shutil
from datetime import datetime, timedelta, timezone
from pathlib import Path

START = datetime(2026, 8, 3, tzinfo=timezone.utc)
DAYS = 3


def _order(n, op, lsn, status, at, price):
    row = {"order_id": f"ord_{n:03d}", "customer_id": f"cus_{n % 7}", "status": status, "currency": "cad" if n % 3 else "usd", "total_minor": price, "ship_region": ["NS", "ON", "QC"][n % 3], "created_at": (START + timedelta(hours=n)).isoformat(), "updated_at": at.isoformat()}
    return json.dumps({"op": op, "ts_ms": 1, "source": {"lsn": lsn}, "before": row if op == "d" else None, "after": None if op == "d" else row})


def _payment(n, kind, version, at, price, suffix=""):
    cur = "cad" if n % 3 else "usd"
    base = {"id": f"evt_{n:03d}{suffix}", "type": f"charge.{kind}", "api_version": version, "created": int(at.timestamp())}
    if version == "2025-11-01":
        obj = {"id": f"ch_{n:03d}", "object": "charge", "order_id": f"ord_{n:03d}", "amount": price, "currency": cur}
        if kind == "refunded":
            obj["refund"] = {"id": f"re_{n:03d}", "amount": 500}
    else:
        obj = {"id": f"ch_{n:03d}" if kind == "succeeded" else f"re_{n:03d}", "object": "charge" if kind == "succeeded" else "refund", "charge": f"ch_{n:03d}", "amount": {"value": price if kind == "succeeded" else 500, "currency": cur.upper()}, "metadata": {"order_id": f"ord_{n:03d}"}}
    return json.dumps(base | {"data": {"object": obj}})


def _put(root: Path, source: str, at: datetime, text: str, resend=False, ext="jsonl"):
    p = root / "landing" / source / f"{at:%Y-%m-%d}" / f"{source}-{at:%Y%m%dT%H}00{'-resend' if resend else ''}.{ext}"
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)


def season(root: Path, seed: int = 22, days: int = DAYS, force: bool = False) -> Path:
    """Orders, payments of two versions, repeats, a truncated line, a file sent twice, late changes, a correction of a rate, settlements.

    ``seed`` decides amounts and rates.  A season that is there already is left alone, unless ``force``: then it goes, with
    all that was made of it.
    """
    if (root / "landing").exists():
        if not force:
            raise FileExistsError(root / "landing")
        for made in ("landing", "bronze", "log", "tables", "gold"):
            shutil.rmtree(root / made, ignore_errors=True)
    price = lambda n: 1000 + random.Random(f"{seed}:{n}").randrange(900)
    money: dict = {}
    for d in range(days):
        day = START + timedelta(days=d)
        for h in (6, 18):
            at = day + timedelta(hours=h)
            ns = range(d * 20 + h, d * 20 + h + 8)
            orders = [_order(n, "c", n * 10, "placed", at, price(n)) for n in ns] + [_order(n, "u", n * 10 + 1, "paid", at, price(n)) for n in ns]
            orders += [_order(n, "d", n * 10 + 5, "paid", at, price(n)) for n in list(ns)[:1]]
            if d:
                orders.append(_order(d * 20 + h - 20, "u", (d * 20 + h - 20) * 10 - 3, "late", at, 1))  # an old change, late
            version = "2026-08-01" if d == 2 else "2025-11-01"
            pays = [_payment(n, "succeeded", version, at - timedelta(minutes=5), price(n)) for n in ns] + [_payment(n, "refunded", version, at - timedelta(minutes=4), price(n), "r") for n in list(ns)[:2]]
            for n in ns:
                cur = "cad" if n % 3 else "usd"
                g = money.setdefault((f"{at:%Y-%m-%d}", cur), [0, 0, 0, 0])
                g[0] += price(n)
                g[2] += 1
                if n in list(ns)[:2]:
                    g[1] += 500
                    g[3] += 1
            text = "\n".join(pays + [pays[0], pays[3][:40]]) + "\n"
            _put(root, "orders", at, "\n".join(orders) + "\n")
            _put(root, "payments", at, text)
            if d == 1 and h == 6:
                _put(root, "payments", at + timedelta(hours=2), text, resend=True)
        _put(root, "fx_rates", day + timedelta(hours=1), f"rate_date,base,quote,rate\n{day - timedelta(days=1):%Y-%m-%d},USD,CAD,1.{30 + random.Random(f"{seed}/{d}").randrange(9)}{d}000\n", ext="csv")
    for (day, cur), (g, r, n, m) in sorted(money.items()):
        at = datetime.fromisoformat(day).replace(tzinfo=timezone.utc) + timedelta(days=1, hours=5 if cur == "cad" else 6)
        _put(root, "settlements", at, f"settlement_date,currency,gross_minor,refunds_minor,net_minor,charge_count,refund_count\n{day},{cur},{g},{r},{g - r},{n},{m}\n", ext="csv")
    return root
