"""Enumerations as names and numbers, contexts, and bits of flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import split_list

# Names in the order of their numbers, from 0.
NAMES = {
    "account_subtype": ("Sip", "SipVoip", "Impp", "VideoShare"),
    "protocol": ("Unknown", "Aim", "Icq", "Irc", "Jabber", "Msn", "Qq", "Skype", "Yahoo"),
    "phone_subtype": ("Landline", "Mobile", "Fax", "Pager", "Voice", "Modem", "Video", "Car", "BulletinBoardSystem", "MessagingCapable", "Assistant", "DtmfMenu"),
    "address_subtype": ("Parcel", "Postal", "Domestic", "International"),
    "anniversary_subtype": ("Wedding", "Engagement", "House", "Employment", "Memorial"),
    "url_subtype": ("HomePage", "Blog", "Favourite"),
    "gender": ("", "Male", "Female"),
    "context": ("Home", "Work", "Other"),
    "presence": ("Unknown", "Available", "Hidden", "Busy", "Away", "ExtendedAway", "Offline"),
}
ADDED, MODIFIED, DELETED = 1, 2, 4
STATUS_BITS = ("hasPhoneNumber", "hasEmailAddress", "hasOnlineAccount", "isOnline", "isDeactivated", "isAdded", "isModified", "isDeleted")


def name_of(kind: str, number: Column) -> Column:
    """'' for an unknown number."""
    return F.coalesce(F.get(F.array(*map(F.lit, NAMES[kind])), number.cast("int")), F.lit(""))


def number_of(kind: str, name: Column) -> Column:
    """-1 for an unknown name."""
    return (F.array_position(F.array(*map(F.lit, NAMES[kind])), name) - 1).cast("int")


def contexts(c: Column) -> Column:
    """Known names of a ;-joined text."""
    return F.filter(split_list(c), lambda x: x.isin(*NAMES["context"]))


def bit(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(mask) != 0


def status_flags(flags: dict[str, Column], change: Column) -> Column:
    """The bit set of five booleans and the change flags."""
    parts = [flags[n] for n in STATUS_BITS[:5]] + [bit(change, ADDED), bit(change, MODIFIED), change >= DELETED]
    total = F.lit(0)
    for i, p in enumerate(parts):
        total = total + F.when(p, 1 << i).otherwise(0)
    return total.cast("int")


def online(state: Column) -> Column:
    return F.coalesce(state.between(1, 5), F.lit(False))


def availability(state: Column) -> Column:
    """Rank of a presence state from most to least available: 1, 4, 5, 3, 2, 6, any other."""
    rank = F.lit(7)
    for i, s in reversed(list(enumerate((1, 4, 5, 3, 2, 6), 1))):
        rank = F.when(state == s, i).otherwise(rank)
    return rank.cast("int")
