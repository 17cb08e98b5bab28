"""The keyword gate's list: a packet that names none of these has no capital source to look for."""

# ---- Fixed values of the contract: label and regular expression between ASCII word boundaries ----
GATE_TERMS = (
    ("investing/investment", "invest(?:s|ed|ing|ment|ments|or|ors)?"),
    ("capital", "capital"),
    ("asset", "assets?"),
    ("wealth", "wealth"),
    ("financial", "financial"),
    ("finance", "finance"),
    ("securities", "securities"),
    ("holdings", "holdings?"),
    ("trust", "trusts?"),
    ("family", "family"),
    ("office", "offices?"),
    ("management", "management"),
    ("advisory", "advisory"),
    ("allocator/allocation", "allocat(?:e|es|ed|ing|ion|ions|or|ors)?"),
    ("capital commitment", "commit(?:s|ted|ting|ment|ments)?"),
    ("limited partner", "limited partners?"),
    ("LP", "lps?"),
    ("fund/funds", "funds?"),
    ("manager", "managers?"),
    ("partner", "partners?"),
    ("partnership", "partnerships?"),
    ("mandate", "mandates?"),
    ("portfolio", "portfolios?"),
    ("advisor", "advisors?"),
    ("investment manager", "investment managers?"),
    ("external manager", "external managers?"),
    ("external investment manager", "external investment managers?"),
    ("external equity manager", "external equity managers?"),
    ("manager selection", "manager selection"),
    ("prospective manager", "prospective managers?"),
    ("private markets", "private markets?"),
    ("private capital", "private capital"),
    ("private", "private"),
    ("equity", "equity"),
    ("venture", "ventures?"),
    ("growth", "growth"),
    ("buyout", "buyouts?"),
    ("debt", "debt"),
    ("absolute return", "absolute return"),
    ("hedge", "hedge"),
    ("alternatives", "alternatives?"),
    ("alternative investments", "alternative investments?"),
    ("family office", "family offices?"),
    ("investment office", "investment offices?"),
    ("endowment", "endowments?"),
    ("pension", "pensions?"),
    ("foundation", "foundations?"),
    ("sovereign wealth", "sovereign wealth"),
    ("OCIO", "ocios?"),
    ("fund-of-funds", "fund[- ]of[- ]funds"),
    ("primary fund investment", "primary fund investments?"),
    ("fund partnership", "fund partnerships?"),
    ("partnership interest", "partnership interests?"),
    ("secondary investment", "secondary investments?"),
    ("secondaries", "secondaries"),
    ("LP secondary", "lp secondaries"),
    ("separate account", "separate accounts?"),
    ("commingled fund", "commingled funds?"),
    ("evergreen fund", "evergreen funds?"),
    ("co-investment", "co[- ]invest(?:s|ed|ing|ment|ments)?"),
    ("general partner", "general partners?"),
    ("GP", "gps?"),
    ("anchor", "anchor"),
    ("emerging", "emerging"),
    ("diverse", "diverse"),
    ("emerging and diverse manager", "emerging and diverse managers?"),
    ("first-time", "first[- ]time"),
    ("institutional", "institutional"),
    ("asset allocation", "asset allocation"),
    ("strategic asset allocation", "strategic asset allocation"),
    ("asset liability management", "asset liability management"),
    ("portfolio allocation", "portfolio allocation"),
    ("portfolio construction", "portfolio construction"),
    ("capital allocation", "capital allocation"),
    ("capital deployment", "capital deployment"),
    ("capital commitments", "capital commitments?"),
    ("investment proposal", "investment proposals?"),
    ("investment mandate", "investment mandates?"),
    ("discretionary capital", "discretionary capital"),
    ("customized investment solution", "customized investment solutions?"),
    ("open architecture", "open[- ]architecture"),
    ("investment committee", "investment committee"),
    ("chief investment officer", "chief investment officer"),
    ("outsourced CIO", "outsourced cio"),
    ("CIO", "cio"),
    ("mission-related investment", "mission[- ]related investments?"),
    ("program-related investment", "program[- ]related investments?"),
    ("endowment partner", "endowment partners?"),
    ("qualified purchaser", "qualified purchasers?"),
    ("accredited investor", "accredited investors?"),
)
# --------------------------------------------------------------------------------------------------
