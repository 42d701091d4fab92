"""Names of event fields: the canonical ones and those of five platforms, and bindings to columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLATFORMS = ("splunk", "qradar", "elastic", "sentinel", "wazuh")

# Canonical name, then the field of each platform in the order of PLATFORMS.
_FIELDS = """
user            user               username         user.name                     Account                    dstuser
src_ip          src_ip             sourceip         source.ip                     IpAddress                  srcip
dest_ip         dest_ip            destinationip    destination.ip                DestinationIp              dstip
src_port        src_port           sourceport       source.port                   SourcePort                 srcport
dest_port       dest_port          destinationport  destination.port              DestinationPort            dstport
hostname        host               logsourcename    host.name                     Computer                   hostname
host            host               logsourcename    host.name                     Computer                   hostname
event_id        EventCode          eventid          event.code                    EventID                    id
event_type      source             QIDNAME(qid)     event.category                EventID                    category
status          status             eventdirection   event.outcome                 Status                     status
action          action             eventdirection   event.action                  Activity                   action
category        category           categoryname     event.category                EventID                    group
severity        severity           severity         event.severity                Level                      level
timestamp       _time              starttime        @timestamp                    TimeGenerated              timestamp
_time           _time              starttime        @timestamp                    TimeGenerated              timestamp
process_name    process_name       filename         process.name                  Process                    program_name
process_id      pid                pid              process.pid                   ProcessId                  pid
parent_process  parent_process     parentpid        process.parent.name           ParentProcessName          ppid
command_line    CommandLine        commandline      process.command_line          CommandLine                cmdline
target_process  TargetProcessName  targetfilename   Target.process.name           TargetProcessName          target_process
src_process     process_name       filename         process.name                  InitiatingProcessFileName  program_name
protocol        protocol           protocolid       network.transport             Protocol                   protocol
direction       direction          eventdirection   network.direction             CommunicationDirection     direction
bytes_out       bytes_out          destinationbytes destination.bytes             SentBytes                  bytes_out
bytes_in        bytes_in           sourcebytes      source.bytes                  ReceivedBytes              bytes_in
file_name       file_name          filename         file.name                     FileName                   file
file_path       file_path          filepath         file.path                     FilePath                   path
file_hash       file_hash          filehash         file.hash.sha256              FileHash                   md5
query_domain    query              domainname       dns.question.name             Name                       dns.question.name
response_size   answer_count       payloadlength    dns.response_code             ResponseCode               dns.response_size
auth_type       LogonType          authtype         winlog.logon.type             LogonType                  auth_type
domain          user_domain        domain           user.domain                   SubjectDomainName          domain
country         country            geographic       source.geo.country_name       LocationDetails            geoip.country_name
attempt_count   attempt_count      attempt_count    attempt_count                 attempt_count              frequency
event_count     event_count        event_count      event_count                   event_count                frequency
unique_targets  unique_targets     unique_targets   unique_targets                unique_targets             frequency
task_name       TaskName           taskname         winlog.event_data.TaskName    TaskName                   task_name
"""
FIELDS: dict[str, dict[str, str]] = {row[0]: dict(zip(PLATFORMS, row[1:])) for row in (line.split() for line in _FIELDS.strip().splitlines())}
#: Values that one family of schemas spells differently.
STATUS_VALUES = {"failed": "failure", "success": "success", "error": "failure"}


def platform_field(name: str, platform: str) -> str:
    """A canonical field's name on a platform; unknown names pass through."""
    return FIELDS.get(name, {}).get(platform, name)


def canonical_fields(physical: str, platform: str) -> list[str]:
    """The canonical names that a platform's field may stand for."""
    return [c for c, by in FIELDS.items() if by[platform] == physical]


def field_table(spark: SparkSession) -> DataFrame:
    """canonical, platform, field: one row per mapping."""
    return spark.createDataFrame([(c, p, by[p]) for c, by in FIELDS.items() for p in PLATFORMS], "canonical string, platform string, field string")


@dataclass
class Binding:
    """Where the canonical fields of a source are: name -> column name or expression.

    Names without an entry pass through.  ``values`` maps literal values of a field before they are compared.
    """

    columns: dict[str, str | Callable[[], Column]] = field(default_factory=dict)
    values: dict[str, dict[str, str]] = field(default_factory=dict)

    def column(self, name: str, alias: str | None = None) -> Column:
        given = self.columns.get(name, name)
        if callable(given):
            return given()
        return F.col(f"{alias}.`{given}`" if alias else given if "." in given else f"`{given}`")

    def value(self, name: str, value):
        return self.values.get(name, {}).get(value.lower(), value) if isinstance(value, str) else value
