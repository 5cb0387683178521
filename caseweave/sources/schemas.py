"""Declared schemas of the input documents and stored tables."""

from __future__ import annotations

INCIDENTS = (
    "incident_id string, crime_type string, crime_category string, occurrence_datetime timestamp, "
    "reported_datetime timestamp, district string, police_station string, latitude double, longitude double, "
    "victim_age int, victim_gender string, offender_age int, offender_gender string, offender_id string, "
    "weapon_used string, modus_operandi string, property_loss double, weather string, festival string, "
    "time_of_day string, weekend boolean, arrest_made boolean, repeat_offender boolean, cctv_available boolean, "
    "case_status string, population_density int, urbanization_index double, socioeconomic_score double"
)
CASE_DOCUMENT = (
    "CaseMasterID bigint, CrimeNo string, CaseNo string, CrimeRegisteredDate date, PoliceStationID int, "
    "PoliceStationName string, DistrictID int, DistrictName string, CaseStatusID int, IncidentFromDate timestamp, "
    "IncidentToDate timestamp, InfoReceivedPSDate timestamp, latitude double, longitude double, BriefFacts string, "
    "mo_tags array<string>, Victim struct<VictimMasterID:bigint,VictimName:string,AgeYear:int>, "
    "Accused struct<AccusedMasterID:bigint,AccusedName:string,AgeYear:int,prior_record_flag:boolean,prior_cases_count:int>, "
    "ActSectionAssociation array<struct<ActID:string,SectionID:string,ActOrderID:int,SectionOrderID:int>>"
)
INTAKE = (
    "fir_number string, incident_type string, reported_at string, occurred_at string, narrative_text string, "
    "created_by string, location struct<latitude:double,longitude:double,district_id:string,address_text:string>, "
    "offenders array<struct<offender_id:string,name:string,aliases:string,role_in_incident:string>>, "
    "victims array<struct<victim_id:string,name:string,contact_info:string>>"
)
STORED_EDGES = (
    "edge_id string, from_node_id string, to_node_id string, relation_type string, incident_id string, "
    "weight double, created_at timestamp"
)
