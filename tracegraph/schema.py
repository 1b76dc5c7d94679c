"""Schema of recorded trace documents and feeds."""

EVENT = ("struct<timestamp:double,event_type:string,element_tag:string,element_id:string,element_class:string,"
         "element_text:string,element_xpath:string,url_before:string,url_after:string,form_data:map<string,string>,"
         "screenshot_path:string,http_status:int>")
REQUEST = "struct<url:string,method:string,resource_type:string,status:int,content_type:string,timestamp:double>"
INNER = (f"struct<url:string,start_time:double,end_time:double,final_url:string,page_title:string,forms_submitted:int,"
         f"redirects:array<string>,console_logs:array<string>,cookies:array<struct<name:string,domain:string,path:string>>,"
         f"events:array<{EVENT}>,network_requests:array<{REQUEST}>>")
TRACE = (f"url string, hash string, source string, label string, success boolean, domain string, crawled_at string, "
         f"final_url string, page_title string, forms_submitted int, dual_submissions int, elements_interacted int, "
         f"trace {INNER}, events array<{EVENT}>, network_requests array<{REQUEST}>, redirects array<string>, _corrupt_record string")
CERT = "common_name string, name_value string, issuer_name string, not_before string"
SCAN = ("_id string, page struct<domain:string,url:string,country:string>, "
        "verdicts struct<overall:struct<malicious:boolean,score:int>>")
TAGGED = "map<string,array<struct<url:string,threat:string,tags:array<string>>>>"
