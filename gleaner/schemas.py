"""Explicit schemas of the tables, as DDL; nothing is inferred from data."""

from __future__ import annotations

FACT = "struct<text:string,timestamp:double,frame:int>"
SEGMENT = "struct<start:double,end:double,text:string>"
TOKENS = ("struct<input:bigint,cache_read:bigint,cache_creation:bigint,output:bigint,cost_usd:double,"
          "backend:string,model:string,salvaged:boolean,finish_reason:string,passes:int>")
VARIANT = (f"struct<backend:string,model:string,summary:string,key_points:array<string>,"
           f"on_screen_text:array<string>,genre:string,tags:array<string>,structured:map<string,string>,"
           f"facts:array<{FACT}>,tokens:{TOKENS},elapsed_s:double,frames:int,created_at:string>")

RECORD = (
    f"id string, url string, author string, author_handle string, title string, `timestamp` timestamp, "
    f"caption string, hashtags array<string>, mentions array<string>, likes bigint, views bigint, "
    f"comments bigint, duration double, video_path string, thumbnail_path string, audio_path string, "
    f"transcript array<{SEGMENT}>, transcript_text string, transcript_language string, "
    f"transcript_translated boolean, transcript_confidence double, ocr_text array<string>, summary string, "
    f"key_points array<string>, on_screen_text array<string>, genre string, tags array<string>, "
    f"structured map<string,string>, facts array<{FACT}>, tokens {TOKENS}, "
    f"variants map<string,{VARIANT}>, markdown_path string, pdf_path string, scraped_at timestamp")

MANIFEST = ("slug string, title string, id string, url string, reel_ids array<string>, updated string")
SOURCES = ("sources array<struct<name:string,url:string,type:string,enabled:boolean,limit:int>>")
ATTEMPT = ("profile string, reel_id string, ok boolean, seconds double, facts int, model string, "
                "error string, at string")
LEDGER_ENTRY = ("struct<last_run:string,runs:int,last_current:int,last_new:int,last_ingested:int,"
                "cumulative_seen:array<string>,failed_ids:array<string>,error:string>")
ANNOTATION_ENTRY = "struct<starred:boolean,read:boolean,archived:boolean,note:string>"
CANDIDATE_ENTRY = ("struct<id:string,url:string,caption:string,author:string,thumbnail_url:string,"
                   "source:string,collection:string,score:double,why:string,state:string,found_on:string>")
RUN_REPORT = (
    "started_at string, finished_at string, config string, source_type string, "
    "reels map<string,struct<url:string,stages:map<string,string>,errors:map<string,string>>>")
MEDIA = ("struct<media_type:int,code:string,saved_collection_ids:array<string>,"
         "carousel_media:array<struct<media_type:int>>,user:struct<username:string>,"
         "caption:struct<text:string>>")
FEED_PAGE = (
    f"items array<struct<media:{MEDIA},media_type:int,code:string,saved_collection_ids:array<string>,"
    f"carousel_media:array<struct<media_type:int>>,user:struct<username:string>,caption:struct<text:string>>>")
RELEASE = ("html_url string, tag_name string, name string, body string, published_at string")
RSS_ITEM = ("title string, link string, description string, `content:encoded` string, "
                 "`dc:creator` string, pubDate string")
ATOM_ENTRY = (
    "id string, title string, link array<struct<_href:string>>, content struct<_VALUE:string>, "
    "summary struct<_VALUE:string>, author array<struct<name:string>>, published string, updated string")
