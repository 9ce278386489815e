"""The patterns that cleaned narratives and context flags must agree on.

Stated as text in verbose form (blanks do not count), ignoring case, in the order they are tried; Java and Python read them alike.
"""

from __future__ import annotations

import re

#: Fixed value: where redaction boilerplate begins.
BOILERPLATE_START = r"""(?ix)
    (
        parts?\s+of\s+this\s+document\s+have\s+been\s+redacted
        |
        redacted\s+to\s+protect\s+personally\s+identifiable\s+information
        |
        information\s+redacted\s+pursuant\s+to\s+the\s+freedom\s+of\s+information\s+act
        |
        pursuant\s+to\s+the\s+free
        |
        freedom\s+of\s+information\s+act\s*\(?foia\)?
        |
        \bfoia\b\s*,?\s*5\s*u\.?s\.?c
    )
"""

#: Fixed value: a dealer's address or number in brackets.
DEALER_ADDRESS = r"""(?ix)
    \(
        [^)]*(?:\b[A-Z]{2}\s*\d{5}(?:-\d{4})? |
            \bphone\s+number\b |
            \b\d{3}[-.)\s]*\d{3}[-.\s]*\d{4}\b |
            \b\d{3,5}\s+[A-Z0-9][A-Z0-9\s]{2,40}(?:rd|road|st|street|ave|avenue|blvd|boulevard|hwy|highway|dr|drive|ln|lane|pkwy|parkway)\b)
        [^)]*
    \)
"""

#: Fixed value: sentences the complaint office adds.
OFFICE_SENTENCES = r"""(?ix)
    (
        (?:^|(?<=[.!?]\s))
        (?:TL\*\s*)?
        the\s+contact\s+own(?:s|ed)\s+an?\s+[^.!?]{2,140}[.!?] |
        \b(?:the\s+)?(?:approximate\s+)?failure\s+mileage\s+(?:was\s+)?(?:approximately\s+)?(?:unknown|unavailable|not\s+available|[\d,]+)[.!?]? |
        \bthe\s+approximate\s+failure\s+mileage\s+was\s+unknown[.!?]? |
        \b(?:the\s+)?contact\s+received\s+notifications?\s+of\s+(?:the\s+)?nhtsa\s+campaign\s+numbers?[:\s]+[0-9A-Z,\sand]+[^.!?]{0,260}? |
        \b(?:the\s+)?contact\s+stated\s+that\s+the\s+manufacturer\s+exceeded\s+a\s+reasonable\s+amount\s+of\s+time\s+for\s+the\s+repair[.!?]? |
        \bvin\s+tool\s+confirms\s+parts?\s+(?:are\s+)?not\s+available[.!?]? |
        \bparts?\s+distribution\s+disconnect[.!?]? |
        \b(?:the\s+)?contact\s+had\s+not\s+experienced\s+(?:a\s+)?failure[.!?]? |
        \b(?:the\s+)?contact\s+had\s+not\s+experienced\s+the\s+failure[.!?]? |
        \b(?:the\s+)?(?:local\s+|unknown\s+|undisclosed\s+)?dealer\s+(?:was\s+)?(?:contacted|made\s+aware|notified)[^.!?]{0,160}?confirmed\s+that\s+(?:the\s+)?parts?\s+(?:was|were)\s+(?:not\s+yet\s+)?available[^.!?]*[.!?]? |
        \b(?:the\s+)?manufacturer\s+(?:was\s+)?(?:contacted|made\s+aware|notified)[^.!?]{0,160}?confirmed\s+that\s+(?:the\s+)?parts?\s+(?:was|were)\s+(?:not\s+yet\s+)?available[^.!?]*[.!?]? |
        \b(?:the\s+)?(?:local\s+|unknown\s+|undisclosed\s+)?dealer\s+(?:stated|confirmed|informed\s+the\s+contact)\s+that\s+(?:the\s+)?parts?\s+(?:was|were)\s+(?:not\s+yet\s+)?(?:available|unavailable|on\s+back\s*order|on\s+backorder)[^.!?]*[.!?]? |
        \b(?:the\s+)?part\s+was\s+(?:not\s+yet\s+)?available[.!?]? |
        \b(?:the\s+)?parts?\s+(?:was|were)\s+(?:not\s+yet\s+)?(?:available|unavailable|on\s+back\s*order|on\s+backorder)[.!?]? |
        \b(?:the\s+)?vin\s+was\s+(?:not\s+available|unavailable|invalid)[.!?]? |
        \binvalid\s+vin[.!?]? |
        \b(?:after\s+investigating\s+the\s+failure,\s+)?the\s+contact\s+(?:related|referenced|associated|linked|was\s+relating)\s+the\s+failures?\s+(?:to|with)\s+(?:nhtsa\s+campaign\s+number|customer\s+satisfaction\s+program|tsb)[:\s]*[^.!?]*[.!?]? |
        \bupon\s+investigation,\s+the\s+contact\s+(?:associated|linked|discovered)\s+[^.!?]{0,80}?(?:nhtsa\s+campaign\s+number|customer\s+satisfaction\s+program|tsb)[^.!?]*[.!?]? |
        \b(?:the\s+)?contact\s+researched\s+online\s+and\s+related\s+the\s+failures?\s+to\s+(?:nhtsa\s+campaign\s+number|customer\s+satisfaction\s+program|tsb)[^.!?]*[.!?]? |
        \b(?:the\s+)?vehicle\s+(?:was|had\s+been|had\s+not\s+been|had\s+yet\s+to\s+be|was\s+not\s+yet)\s+(?:not\s+)?(?:diagnosed|repaired|diagnosed\s+(?:or|nor)\s+repaired|taken\s+to\s+be\s+diagnosed\s+(?:or|nor)\s+repaired)[^.!?;]*[.!?]? |
        \b(?:the\s+)?vehicle\s+was\s+not\s+taken\s+to\s+(?:a\s+)?(?:local\s+)?dealer\s+or\s+(?:an\s+)?independent\s+mechanic[^.!?]*[.!?]? |
        \b(?:the\s+)?vehicle\s+was\s+not\s+taken\s+to\s+(?:a\s+)?dealer[^.!?]*[.!?]? |
        \b(?:the\s+)?vehicle\s+was\s+taken\s+to\s+(?:the\s+)?(?:local\s+)?dealer\s+to\s+be\s+diagnosed[.!?]? |
        \b(?:the\s+)?vehicle\s+was\s+taken\s+to\s+(?:an\s+)?independent\s+mechanic\s+to\s+be\s+diagnosed[.!?]? |
        \b(?:the\s+)?vehicle\s+was\s+towed\s+to\s+(?:the\s+)?(?:local\s+)?(?:dealer|residence|contact'?s\s+residence|tow\s+yard|tow\s+lot)[^.!?]*[.!?]? |
        \b(?:the\s+)?vehicle\s+remained\s+at\s+the\s+dealer\s+unrepaired[.!?]? |
        \b(?:the\s+)?vehicle\s+was\s+not\s+repaired\s+due\s+to\s+the\s+cost[.!?]? |
        \b(?:the\s+)?vehicle\s+was\s+not\s+repaired\s+and\s+remained\s+(?:at|in\s+the\s+possession\s+of)\s+the\s+dealer [.!?]? |
        \b(?:the\s+)?manufacturer\s+(?:was|had\s+been|had\s+not\s+been|had\s+yet\s+to\s+be|was\s+not\s+yet)\s+(?:not\s+)?(?:made\s+aware|notified|informed|contacted)(?:\s+of\s+(?:the\s+)?(?:failure|issue|recall))?[^.!?]*[.!?]? |
        \b(?:the\s+)?manufacturer\s+(?:was\s+also\s+)?notified\s+of\s+(?:the\s+)?(?:failure|issue)[^.!?]*[.!?]? |
        \b(?:the\s+)?manufacturer\s+was\s+contacted[^.!?]*[.!?]? |
        \b(?:the\s+)?(?:local\s+|unknown\s+|undisclosed\s+)?dealer\s+(?:was|had\s+been|was\s+not)\s+(?:not\s+)?(?:contacted|notified|made\s+aware|informed)(?:\s+of\s+(?:the\s+)?(?:failure|issue))?[^.!?]*[.!?]? |
        \b(?:the\s+)?(?:local\s+)?dealer\s+and\s+(?:the\s+)?manufacturer\s+were\s+(?:not\s+)?(?:contacted|notified|made\s+aware|informed)(?:\s+of\s+(?:the\s+)?(?:failure|issue))?[^.!?]*[.!?]? |
        \bneither\s+the\s+dealer\s+nor\s+the\s+manufacturer\s+were\s+notified\s+of\s+(?:the\s+)?(?:failure|issue)[^.!?]*[.!?]? |
        \b(?:no\s+additional\s+|no\s+further\s+)?assistance\s+was\s+(?:provided|offered)[.!?]? |
        \b(?:the\s+)?manufacturer\s+(?:provided|offered)\s+no\s+assistance[.!?]? |
        \b(?:the\s+)?manufacturer\s+was\s+notified\s+of\s+the\s+failure,\s+but\s+no\s+assistance\s+was\s+(?:provided|offered)[.!?]? |
        \b(?:the\s+)?manufacturer\s+was\s+notified\s+of\s+the\s+failure\s+but\s+(?:provided|offered)\s+no\s+assistance[.!?]? |
        \b(?:a\s+)?case\s+was\s+(?:opened|filed)[.!?]? |
        \b(?:the\s+)?manufacturer\s+(?:opened|filed)\s+a\s+case[.!?]? |
        \b(?:the\s+)?manufacturer\s+was\s+notified\s+of\s+the\s+failure\s+and\s+(?:a\s+)?case\s+was\s+(?:opened|filed)[.!?]? |
        \b(?:the\s+)?contact\s+was\s+(?:referred|advised)\s+to\s+(?:contact\s+)?the\s+nhtsa\s+hotline[^.!?]*[.!?]? |
        \b(?:the\s+)?manufacturer\s+referred\s+the\s+contact\s+to\s+the\s+nhtsa\s+hotline[^.!?]*[.!?]? |
        \b(?:the\s+)?manufacturer\s+was\s+made\s+aware\s+of\s+the\s+failure\s+and\s+referred\s+the\s+contact\s+to\s+(?:the\s+)?nhtsa\s+hotline[^.!?]*[.!?]? |
        \b(?:a|no)\s+police\s+report\s+was\s+(?:not\s+)?filed[.!?]? |
        \ba\s+police\s+report\s+was\s+taken\s+at\s+the\s+scene[.!?]? |
        \b(?:a\s+)?fire\s+(?:department\s+)?report\s+was\s+filed[.!?]? |
        \b(?:there\s+were\s+)?no\s+injur(?:y|ies)\s+(?:were\s+)?(?:sustained|reported)[.!?]? |
        \bno\s+medical\s+attention\s+was\s+required[.!?]? |
        \b(?:there\s+(?:was|were)\s+)?no\s+warning\s+(?:light|lights|lamp|lamps)\s+(?:was|were\s+)?illuminated[.!?]? |
        \bno\s+warning\s+lights?\s+illuminated[.!?]? |
        \bseveral\s+unknown\s+warning\s+(?:lights|lamps)\s+(?:were\s+)?illuminated[.!?]? |
        \ban\s+unknown\s+warning\s+light\s+was\s+illuminated[.!?]? |
        \b(?:the\s+)?cause\s+of\s+the\s+failure\s+was\s+not(?:\s+yet)?\s+determined[.!?]? |
        \bno\s+further\s+information\s+was\s+available[.!?]?
    )
"""

#: Fixed value: phrases of the complaint form.
OFFICE_PHRASES = r"""(?ix)
    \b(
        consumer\s+writes\s+in\s+regards\s+to |
        (consumer|contact|owner|driver|complainant)\s+(?:also\s+)?(states|stated|has|had|owns|owned|leased)(?:\s+that)? |
        (consumer|contact|owner|driver|complainant)\s+(received|called|indicated|referenced|related|took|sent) |
        (?:please\s+)?see\s+(?:the\s+)?attached(?:\s+(?:document|documents|complaint|file|files|statement|letter|pdf))?(?:\s+(?:for|with)\s+complaint)? |
        vehicle\s+(was|is|had) |
        manufacturer\s+was\s+notified |
        dealer\s+was\s+notified |
        (?:what\s+)?component\s+or\s+system\s+failed\s+or\s+malfunctioned\s |
        (?:is\s+it\s+)?available\s+for\s+inspection\s+upon\s+request |
        how\s+was\s+your\s+safety\s+or\s+the\s+safety\s+of\s+others\s+put\s+at\s+risk |
        has\s+the\s+problem\s+been\s+reproduced(?:\s+or\s+confirmed(?:\s+by\s+(?:an?\s+)?(?:independent\s+)?dealer(?:\s+or\s+(?:independent\s+)?(?:service\s+center|shop))?)?)? |
        (?:has\s+the\s+)?(?:vehicle\s+or\s+)?component\s+been\s+inspected(?:\s+by\s+the\s+manufacturer(?:,\s+police,\s+insurance\s+representatives(?:,)?\s+or\s+others)?)? |
        were\s+there\s+any\s+warning\s+(lamps|lights) |
        (?:warning\s+)?messages\s+or\s+(?:other\s+)?symptoms |
        problem\s+prior\s+to\s+the\s+failure(?:,\s+and\s+when\s+did\s+the\s+first\s+appear) |
        failure\s+mileage |
        approximate\s+failure\s+mileage |
        vehicle\s+was\s+not\s+diagnosed |
        vehicle\s+was\s+not\s+repaired |
        not\s+diagnosed\s+or\s+repaired |
        not\s+diagnosed\s+nor\s+repaired |
        manufacturer\s+was\s+not\s+notified |
        dealer\s+was\s+not\s+contacted |
        local\s+dealer\s+was\s+not\s+contacted |
        warning\s+light(?:s)?\s+(?:was\s+)?illuminated |
        while\s+driving\s+at\s+an\s+undisclosed\s+speed |
        while\s+driving\s+at\s+an\s+unknown\s+speed |
        at\s+an\s+undisclosed\s+speed |
        at\s+an\s+unknown\s+speed |
        the\s+vehicle\s+was\s+taken\s+to\s+the\s+local\s+dealer |
        the\s+vehicle\s+was\s+taken\s+to\s+an\s+independent\s+mechanic |
        the\s+vehicle\s+was\s+taken\s+to\s+the\s+dealer |
        where\s+it\s+was\s+diagnosed\s+that |
        where\s+it\s+was\s+determined\s+that |
        needed\s+to\s+be\s+replaced |
        was\s+diagnosed\s+that |
        was\s+determined\s+that |
        campaign\s+number
    )\b[\s,:;-]*
"""

#: Fixed value: recall paperwork.
RECALL_PHRASES = r"""(?ix)
    (
        exceeded\s+a\s+reasonable\s+amount\s+of\s+time\s+for\s+the\s+recall\s+repair |
        vin\s+tool\s+confirms\s+parts?\s+not\s+available |
        parts?\s+distribution\s+disconnect |
        parts?\s+(?:was|were)\s+(?:not\s+yet\s+)?(?:available|unavailable|on\s+back\s*order|on\s+backorder) |
        vin\s+was\s+not\s+included\s+in\s+(?:the\s+recall|nhtsa\s+campaign) |
        nhtsa\s+campaign\s+number |
        recall\s+status\s+recall\s+incomplete\s+remedy\s+not\s+yet\s+available |
        \bhowever,\s+the\s+(?:part|parts)\s+to\s+do\s+the\s+recall\s+repairs?\s+(?:was|were)\s+(?:not\s+yet\s+)?(?:available|unavailable)[.!?]? |
        \b(?:the\s+)?contact\s+stated\s+that\s+the\s+manufacturer\s+(?:had\s+)?exceeded\s+a\s+reasonable\s+amount\s+of\s+time\s+for\s+the\s+recall\s+repairs?[.!?]? |
        \b(?:the\s+)?contact\s+was\s+informed\s+that\s+(?:the\s+)?(?:vehicle|vin)\s+was\s+not\s+included\s+in\s+(?:nhtsa\s+campaign\s+number[:\s]+[0-9A-Z]+[^.!?]*|the\s+recall)[.!?]? |
        \b(?:the\s+)?(?:vehicle|vin)\s+was\s+not\s+included\s+in\s+(?:nhtsa\s+campaign\s+number[:\s]+[0-9A-Z]+[^.!?]*|the\s+recall)[.!?]? |
        \b(?:the\s+)?contact\s+was\s+informed\s+that\s+(?:the\s+)?vin\s+was\s+not\s+under\s+recall[.!?]? |
        \bparts\s+not\s+(?:yet\s+)?available\b |
        \bconfirmed\s+that\s+parts\b.{0,30}\bnot\s+(?:yet\s+)?available\b |
        \brecall\b.{0,120}\b(?:part|parts)\b.{0,40}\bnot\s+(?:yet\s+)?available\b |
        \brecall\s+repair\b.{0,40}\bnot\s+(?:yet\s+)?available\b |
        \bpart\s+to\s+do\s+the\s+recall\s+repair\b.{0,40}\bnot\s+(?:yet\s+)?available\b |
        \bparts\s+distribution\s+disconnect\b |
        \bdistribution\s+disconnect\b |
        \bexceeded\s+a\s+reasonable\s+amount\s+of\s+time\b |
        \bexceeded\s+reasonable\s+time\b |
        \brecall\b.{0,160}\breasonable\s+amount\s+of\s+time\b |
        (?:part|parts)\s+to\s+do\s+the\s+recall\s+repairs?\s+(?:was|were)\s+(?:not\s+yet\s+)?(?:available|unavailable)[^.!?]*[.!?]?
    )
"""

#: Fixed value: lead-ins.
LEAD_INS = r"""(?ix)
    \b(
        at\s+an?\s+(?:undisclosed|unknown)\s+speed |
        at\s+various\s+speeds |
        while\s+driving\s+at\s+an?\s+(?:undisclosed|unknown)\s+speed |
        (?:was\s+)?taken\s+to\s+(?:an?\s+)?(?:independent\s+)?(?:mechanic|dealer|local\s+dealer)(?:\s+who)?\s+(?:diagnosed|determined|informed\s+the\s+contact)\s+(?:that\s+)? |
        (?:an?\s+)?(?:independent\s+)?mechanic\s+(?:diagnosed|determined|informed\s+the\s+contact)\s+(?:that\s+)? |
        (?:the\s+)?dealer\s+(?:diagnosed|determined|informed\s+the\s+contact)\s+(?:that\s+)? |
        (?:the\s+)?contact\s+was\s+informed\s+(?:that\s+)? |
        (?:the\s+)?contact\s+was\s+advised\s+(?:that\s+)? |
        (?:the\s+)?contact\s+stated\s+(?:that\s+)? |
        (?:the\s+)?contact\s+also\s+stated\s+(?:that\s+)? |
        (?:the\s+)?contact\s+indicated\s+(?:that\s+)? |
        (?:the\s+)?contact\s+reported\s+(?:that\s+)? |
        the\s+failure\s+recurred |
        the\s+failure\s+reoccurred |
        the\s+failure\s+persisted |
        the\s+failure\s+was\s+intermittent |
        the\s+failure\s+had\s+been\s+recurring |
        the\s+failure\s+had\s+been\s+reoccurring |
        failure\s+became\s+a\s+regular\s+occurrence
    )\b[\s,:;-]*
"""

#: Fixed value: the vehicle is moving.
IN_OPERATION = r"""(?ix)
    \b(
        while\s+driving |
        when\s+driving |
        while\s+operating |
        during\s+operation |
        while\s+the\s+vehicle\s+was\s+in\s+motion |
        while\s+in\s+motion |
        in\s+motion |
        while\s+traveling |
        while\s+driving\s+on |
        driving\s+on\s+the |
        driving\s+approximately |
        at\s+approximately\s+\d{1,3}\s*mph |
        approximately\s+\d{1,3}\s*mph |
        at\s+\d{1,3}\s*mph
    )\b
"""

#: Fixed value: fast roads.
HIGHWAY = r"""(?ix)
    \b(
        highway |
        interstate |
        freeway |
        expressway |
        highway\s+speed |
        freeway\s+speed |
        interstate\s+speed
    )\b
"""

#: Fixed value: critical events.
CRITICAL = r"""(?ix)
    \b(
        stall(?:ed|ing)? |
        shut\s+off |
        turned\s+off |
        lost\s+(?:all\s+)?power |
        loss\s+of\s+(?:motive\s+)?power |
        lost\s+motive\s+power |
        would\s+not\s+accelerate |
        could\s+not\s+accelerate |
        failed\s+to\s+accelerate |
        brake(?:s)?\s+(?:failed|failure) |
        brake\s+pedal\s+(?:went\s+to\s+the\s+floor|soft|hard) |
        could\s+not\s+stop |
        unable\s+to\s+stop |
        could\s+not\s+steer |
        unable\s+to\s+steer |
        steering\s+(?:locked|seized) |
        caught\s+fire |
        fire |
        smoke |
        air\s*bags?\s+did\s+not\s+deploy |
        air\s*bags?\s+failed\s+to\s+deploy
    )\b
"""


def compact(pattern: str) -> str:
    """A verbose pattern without its blanks, for engines that have no verbose form."""
    return "(?i)" + re.sub(r"\s+", "", pattern.removeprefix("(?ix)"))
