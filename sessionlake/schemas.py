"""Explicit schemas of the sources; nothing is inferred."""

from __future__ import annotations

SESSION_ENTRY = "struct<sessionId:string,id:string,fullPath:string,fileMtime:bigint,firstPrompt:string,summary:string,messageCount:int,created:string,modified:string,lastActive:string,gitBranch:string,projectPath:string,isSidechain:boolean>"
SESSIONS_INDEX = f"struct<version:int,originalPath:string,entries:array<{SESSION_ENTRY}>>"
PROJECT = "struct<name:string,originalPath:string,encodedPaths:array<string>,workDays:array<string>>"
PROJECTS_INDEX = f"struct<version:int,lastUpdated:string,projects:map<string,{PROJECT}>,pathVariations:map<string,array<string>>>"
FIRST_LINE = "struct<cwd:string,timestamp:string>"
SESSIONS = "project_hash string, session_id string, transcript_path string, file_mtime timestamp, file_size bigint"
