"""Row shapes of the data model."""

from __future__ import annotations

#: A resource's chain: kind is head or tombstone.
REVISION = "ns string, resource string, seq long, id string, parent string, kind string, patches string, author string, via array<string>, created timestamp_ntz, gesture string, undoes string"
#: A namespace's log: kind is head, tombstone, purge, config, batch, purge-ns, branch or prune.
NS_ENTRY = "ns string, seq long, id string, prev string, kind string, resource string, target string, entries array<struct<kind:string,resource:string,target:string>>, created timestamp_ntz, author string"
DOC = "ns string, resource string, head string, schema string, doc string"
#: Index rows, one for each value of a marked path.
FACET = "ns string, resource string, path string, value string, raw string"
SORT = "ns string, resource string, path string, rank int, num double, str string, bool boolean, raw string"
TEXT = "ns string, resource string, path string, body string"
REF = "ns string, resource string, path string, ref string, target_ns string, target string, rev string, entry string"
