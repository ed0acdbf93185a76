"""Lines labelled by hand: [[kind|text]] marks a span. All people, numbers and addresses are invented."""

from __future__ import annotations

import re

LINES = """
Write to [[email|nora.lindt@posthof.example]] if the parcel is late, or call [[phone|+49 (0)30 5550 1234]] before noon.
My old address [[email|nlindt @ posthof . example]] still works, the new one is [[email|nora@lindt-werke.example.org]].
Ring the desk at [[phone|(212) 555-0143]] or, after hours, at [[phone|212.555.0199]].
The gateway answers at [[ip|10.40.2.17]] and the backup at [[ip|10 . 40 . 2 . 18]] until Friday.
We blocked [[ip|203[.]0[.]113[.]54]] after 300 failed logins on 12.05.2019 at 14:33.
Card on file: [[card|4111 1111 1111 1111]], expires 09/27, billed 129.90 EUR.
She read me the number as [[card|5500-0000-0000-0004]] and I noted it down.
Refund goes to [[card|3400.0000.0000.009]] within 14 days, reference 2024-00817.
Invoice 20240817-44 lists 3 items at 12.50, 8.75 and 100.00, total 121.25.
ISBN 978-3-16-148410-0 and ISBN 0-306-40615-2 are both out of print.
The meeting moved from 2019-12-31 to 2020-01-07, room 4.12, floor 4.
Version 2.14.3 fixes bug 88213; version 2.15 is due in week 32.
Population grew from 1 204 500 to 1 377 900 between 1990 and 2010.
Contact: [[email|sales+spring@shop.example.net]]; fax [[phone|+1 212 555 0170]]; no visits.
Tel. [[phone|030/5550 7788]] (office), mobile [[phone|0171 555 0 123]].
@maria asked @jonas_w about 5 pm, and 25 people said yes @ the lake.
Opening hours 9-12 and 14-18, prices from 5,00 to 15,00.
The score was 21:19, 18:21, 15:13 after 74 minutes.
ping [[ip|192.168.0.1]] gave 64 bytes, ttl 57, time 11.3 ms, seq 1 2 3 4.
Mail [[email|b.okafor@ mail7.example.com]] or fax [[phone|+44 20 7946 0958]] today.
Order no. 1234567890 shipped in 2 boxes of 12 and 1 box of 6.
Coordinates 48.13743, 11.57549 and 52.52000, 13.40495 were wrong.
Account 0044 0532 0130 00 belongs to the club; ask [[email|kasse@verein.example]].
sha1 24be64439e3e49cf46b2d7c90f3602a3d0b907ff, build 20240105.3
Customer service [[phone|1-800-555-0111]], quote case 55-0111-2.
Her direct line is [[phone|(0)20 7946 0123]]; extension 55.
Payment by [[card|6011000000000004]] was declined twice on 03.04.
Between 10 000 and 15 000 visitors came, 2 500 of them on day 1.
The hosts [[ip|172.16.254.1]], [[ip|172.16.254.2]] and db03 are down.
Chapter 4.1.2 cites pages 33-47, 101 and 250-255 of volume 12.
Escalate to ops ([[email|on-call@ops.example.io]], [[phone|+1 (415) 555-0136]]) at once.
a1@b, x@y and user@localhost are no addresses that we can reach.
"""


def parsed(lines: str) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Each line without its marks, and its spans (start, end, kind)."""
    out = []
    for line in lines.strip().split("\n"):
        text, spans, at = "", [], 0
        for m in re.finditer(r"\[\[(\w+)\|(.*?)\]\](?!\])", line):
            text += line[at : m.start()]
            spans.append((len(text), len(text) + len(m[2]), m[1]))
            text, at = text + m[2], m.end()
        out.append((text + line[at:], spans))
    return out
