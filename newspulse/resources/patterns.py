"""Pattern families for the topical filter and the currency classes.

Fixed values: these word patterns decide which articles are kept and how titles are classed, so they
have to equal the wording of the application they serve. Other topics pass their own families.
"""

from __future__ import annotations

EURUSD_NEWS = {
    "drop": [
        r"\b(earnings|quarterly results|q[1-4]\s*\d{4}|eps|guidance|revenue|profit|net income|dividend|buyback|ipo|spinoff)\b",
        r"\b(downgrades?|upgrades?)\b",
    ],
    "drop_unless_allowed": [
        r"\b(bitcoin|btc|ethereum|eth|altcoin|crypto(?!-?euro)|defi|nft)\b",
    ],
    "allow": [
        r"\b(euro[-\s]?stablecoin|euro[-\s]?coin|euroc|eurc|eurt|stasis|euro tether|eur[-\s]?stablecoin)\b",
    ],
    "include": [
        r"\b(eur\s*/\s*usd|usd\s*/\s*eur)\b",
        r"\b(us\s*dollar|u\.s\.\s*dollar|usd|greenback|king\s*dollar)\b",
        r"\b(euro(zone| area)?|eur|single\s*currency)\b",
        r"\b(dxy|u\.s\.\s*dollar\s*index|dollar\s*index|bloomberg\s*dollar\s*spot\s*index)\b",
        r"\b(fxe|uup)\b",
        r"\b(ecb|european central bank|lagarde|panetta|cipollone|schaaf)\b",
        r"\b(fed|federal reserve|fomc|powell)\b",
        r"\b(cpi|hicp|pce|nfp|non[-\s]?farm|payrolls|unemployment|pmi|gdp|ifo|zew|recession|stagflation|inflation|deflation|disinflation)\b",
        r"\b(rate(s)?|hike|cut|pivot|pause|qe|qt|balance sheet|dot plot)\b",
        r"\b(tariff(s)?|dut(y|ies)|sanction(s)?|trade\s*war|export controls?|anti[-\s]?dumping|wto dispute)\b",
        r"\b(geopolitic(s|al)|war|conflict|invasion|missile|strike|escalation|coup|border\s*clash|attack|terror)\b",
        r"\b(euro[-\s]?stablecoin|euroc|eurc|eurt|stasis|euro tether|eur[-\s]?stablecoin|digital\s*euro|mica|bafin|allunity)\b",
    ],
}

CURRENCIES = {
    "USD": [r"\busd\b", r"\bus\.?dollars?\b", r"\bdollars?\b", r"\bgreenbacks?\b", r"\bking\s*dollars?\b"],
    "EUR": [r"\beur\b", r"\beuros?\b", r"\bsingle\s*currenc(y|ies)\b", r"\beurozone\b", r"\beuro\s*area\b"],
}
