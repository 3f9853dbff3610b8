"""Schemas of snapshots, registers and stored records."""

from __future__ import annotations

# Field names and types of the wire format.
CHAINS = (
    "id string, name string, status string, severity string, confidence double, startedAt string, lastSeenAt string, alertsCount bigint, killChainProgress double, "
    "tactics array<string>, techniques array<string>, attackerAssets array<string>, targetAssets array<string>, summary string, "
    "steps array<struct<ts:string,tactic:string,technique:string,title:string,dc:string,asset:string,confidence:double,evidence:string>>"
)
ALERTS = (
    "id string, timestamp string, assetId string, datacomponent string, techniqueIds array<string>, tacticIds array<string>, severity string, message string, signalScore double, chainId string, "
    "layerA struct<pTruePositive:double,decision:string,usedSafetyRail:boolean,driftAlarm:boolean>, layerB struct<chainId:string,confidence:double,techniques:array<string>,tactics:array<string>>, "
    "layerC struct<action:string,confidence:double,rationale:string,usedSafetyRail:boolean,avarHit:boolean>, layerD struct<ready:boolean>, srcIps array<string>, destIps array<string>, rawLog string"
)
LOGS = "id string, timestamp string, source string, level string, assetId string, datacomponent string, message string, alertId string"
MITIGATIONS = (
    "id string, chainId string, alertIds array<string>, title string, priority string, appliesToTechniques array<string>, appliesToAssets array<string>, appliesToZones array<string>, "
    "kgMitigationId string, kgMitigationName string, rationale string, implementation array<string>, approvalRequired boolean, rollback string, status string, "
    "sources array<struct<type:string,id:string,label:string>>, requiresHumanApproval boolean, grounding struct<kgPath:array<string>,retrievedAt:string>"
)
STATS = (
    "activeChains bigint, containedChains bigint, alertsLast24h bigint, criticalAlerts24h bigint, mitigationsProposed bigint, mitigationsImplemented bigint, falsePositiveRate double, avgLatencyMs bigint, "
    "p95LatencyMs bigint, classifierAUROC double, avarEntries bigint, driftAlarms bigint, alertsPerHour array<bigint>, tacticsDistribution array<struct<tactic:string,label:string,count:bigint>>, "
    "assetHeat array<struct<assetId:string,count:bigint>>, triageActions map<string,bigint>, recentFeedback array<struct<at:string,analyst:string,verdict:string,alertId:string>>"
)
RECORDS = {
    "attack_chain_records": "id bigint, site_id bigint, external_id string, status_tag string, payload string, created_at timestamp, updated_at timestamp",
    "alert_records": "id bigint, site_id bigint, external_id string, payload string, created_at timestamp, updated_at timestamp",
    "mitigation_records": "id bigint, site_id bigint, external_id string, payload string, applied boolean, applied_at timestamp, created_at timestamp, updated_at timestamp",
    "assistant_conversations": "id bigint, site_id bigint, title string, created_at timestamp, updated_at timestamp",
    "assistant_messages": "id bigint, conversation_id bigint, role string, content string, created_at timestamp",
}
REGISTER = {
    "assets": "asset_id string, asset_name string, asset_type string, manufacturer string, model string, status string, criticality string, zone string, ip_address array<string>, hostname string, protocols array<string>, vulnerabilities array<string>, last_patch_date string",
    "network_interfaces": "interface_id string, asset_id string, interface_name string, type string, mac_address string, ip_address string, vlan string, status string",
    "network_ranges": "range_id string, network_name string, start_ip string, end_ip string, cidr string, gateway string, zone string",
    "connections": "connection_id string, source_asset_id string, source_interface string, destination_asset_id string, destination_interface string, connection_type string, protocol string, port string, bandwidth string, latency string, reliability string, security_level string",
    "software": "software_id string, asset_id string, name string, version string, vendor string, type string, patch_level string, end_of_life string, vulnerabilities array<string>",
    "security_zones": "zone_id string, zone_name string, description string, security_requirements string, network_segment string, typical_assets array<string>",
    "protocols_used": "protocol_id string, protocol_name string, standard string, purpose string, ports array<bigint>, encryption string, authentication string, vulnerabilities array<string>, security_recommendations string",
}
