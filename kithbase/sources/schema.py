"""The fixed schemas: records, detail header and the typed detail tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_TYPES = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "t": T.TimestampType(), "D": T.DateType(), "x": T.BinaryType(), "S": T.ArrayType(T.StringType()), "I": T.ArrayType(T.IntegerType())}
_KINDS = {"s": "string", "i": "int", "l": "int", "d": "real", "b": "bool", "t": "timestamp", "D": "date", "x": "blob", "S": "list", "I": "list"}


def schema(text: str) -> T.StructType:
    """name:type pairs; types are one letter."""
    return T.StructType([T.StructField(n, _TYPES[k]) for n, k in (x.split(":") for x in text.split())])


@dataclass(frozen=True)
class DetailType:
    """unique: at most one a record. sortable: joined for sorting. promoted: copied to aggregates."""

    name: str
    fields: str
    unique: bool = False
    sortable: bool = False
    promoted: bool = True

    @property
    def payload(self) -> T.StructType:
        return schema(f"detailId:l contactId:l {self.fields}")

    def kind(self, field: str) -> str:
        return _KINDS[dict(x.split(":") for x in self.fields.split())[field]]


_PRESENCE = "presenceState:i timestamp:t nickname:s customMessage:s presenceStateText:s presenceStateImageUrl:s"
# The detail types, in the order in which they are assembled.
DETAIL_TYPES = {
    t.name: t
    for t in (
        DetailType("Address", "street:s postOfficeBox:s region:s locality:s postCode:s country:s subTypes:I"),
        DetailType("Anniversary", "originalDateTime:D calendarId:s subType:i event:s"),
        DetailType("Avatar", "imageUrl:s videoUrl:s avatarMetadata:s"),
        DetailType("Birthday", "birthday:D calendarId:s", unique=True, sortable=True),
        DetailType("DisplayLabel", "displayLabel:s displayLabelGroup:s displayLabelGroupSortOrder:i", unique=True, sortable=True, promoted=False),
        DetailType("EmailAddress", "emailAddress:s lowerEmailAddress:s"),
        DetailType("Family", "spouse:s children:S"),
        DetailType("Favorite", "isFavorite:b", unique=True),
        DetailType("Gender", "gender:i", unique=True),
        DetailType("GeoLocation", "label:s latitude:d longitude:d accuracy:d altitude:d altitudeAccuracy:d heading:d speed:d timestamp:t"),
        DetailType("GlobalPresence", _PRESENCE, unique=True, sortable=True, promoted=False),
        DetailType("Guid", "guid:s", sortable=True, promoted=False),
        DetailType("Hobby", "hobby:s"),
        DetailType("Name", "firstName:s lowerFirstName:s lastName:s lowerLastName:s middleName:s prefix:s suffix:s customLabel:s", unique=True, sortable=True),
        DetailType("Nickname", "nickname:s lowerNickname:s"),
        DetailType("Note", "note:s"),
        DetailType("OnlineAccount", "accountUri:s lowerAccountUri:s protocol:i serviceProvider:s capabilities:S subTypes:I accountPath:s accountIconPath:s enabled:b accountDisplayName:s serviceProviderDisplayName:s"),
        DetailType("Organization", "name:s role:s title:s location:s department:S logoUrl:s assistantName:s"),
        DetailType("PhoneNumber", "phoneNumber:s subTypes:I normalizedNumber:s"),
        DetailType("Presence", _PRESENCE),
        DetailType("Ringtone", "audioRingtone:s videoRingtone:s vibrationRingtone:s"),
        DetailType("SyncTarget", "syncTarget:s", unique=True, promoted=False),
        DetailType("Tag", "tag:s"),
        DetailType("Url", "url:s subTypes:I"),
        DetailType("OriginMetadata", "id:s groupId:s enabled:b", unique=True, sortable=True, promoted=False),
        DetailType("ExtendedDetail", "name:s data:x"),
    )
}
CONTACTS = schema(
    "contactId:l collectionId:l created:t modified:t deleted:t hasPhoneNumber:b hasEmailAddress:b hasOnlineAccount:b isOnline:b isDeactivated:b changeFlags:i unhandledChangeFlags:i type:i"
)
HEADER = schema(
    "detailId:l contactId:l detail:s detailUri:s linkedDetailUris:S contexts:S accessConstraints:i provenance:s modifiable:b nonexportable:b changeFlags:i unhandledChangeFlags:i created:t modified:t"
)
COLLECTIONS = schema("collectionId:l aggregable:b name:s description:s color:s secondaryColor:s image:s applicationName:s accountId:i remotePath:s changeFlags:i recordUnhandledChangeFlags:b")
COLLECTION_METADATA = schema("collectionId:l key:s value:x")
RELATIONSHIPS = schema("firstId:l secondId:l type:s")
OOB = schema("name:s value:x compressed:i")
IDENTITIES = schema("identity:i contactId:l")
TABLES = {"contacts": CONTACTS, "details": HEADER, "collections": COLLECTIONS, "collections_metadata": COLLECTION_METADATA, "relationships": RELATIONSHIPS, "oob": OOB, "identities": IDENTITIES, **{n: t.payload for n, t in DETAIL_TYPES.items()}}
SELF_LOCAL, SELF_AGGREGATE = 1, 2
AGGREGATE_COLLECTION, LOCAL_COLLECTION = 1, 2


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    """A database without records."""
    return {n: spark.createDataFrame([], s) for n, s in TABLES.items()}


def initial(spark: SparkSession, aggregating: bool = True) -> dict[str, DataFrame]:
    """A database with the built-in collections and self records."""
    db = empty(spark)
    collections = [(LOCAL_COLLECTION, aggregating, "local"), *([(AGGREGATE_COLLECTION, False, "aggregate")] if aggregating else [])]
    db["collections"] = spark.createDataFrame([(i, a, n, None, None, None, None, None, None, None, 0, False) for i, a, n in collections], COLLECTIONS)
    own = [(SELF_LOCAL, LOCAL_COLLECTION), (SELF_AGGREGATE, AGGREGATE_COLLECTION)] if aggregating else [(SELF_AGGREGATE, LOCAL_COLLECTION)]
    db["contacts"] = spark.createDataFrame([(i, c, None, None, None, False, False, False, False, False, 0, 0, 0) for i, c in own], CONTACTS)
    if aggregating:
        db["relationships"] = spark.createDataFrame([(SELF_AGGREGATE, SELF_LOCAL, "Aggregates")], RELATIONSHIPS)
    db["identities"] = spark.createDataFrame([(0, SELF_AGGREGATE)], IDENTITIES)
    return db
