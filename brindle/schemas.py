"""Schemas of the tables that pass between operators."""

CALL = "struct<name:string,lineno:int>"
PARAMETER = "struct<name:string,kind:string,annotation:string,default:string>"

FILES = "path string, content string"
FUNCTION = (
    f"struct<name:string,start_line:int,end_line:int,is_async:boolean,is_nested:boolean,class_name:string,parameters:array<{PARAMETER}>,"
    f"return_annotation:string,signature:string,docstring:string,content:string,calls:array<{CALL}>>"
)
CLASS = "struct<name:string,start_line:int,end_line:int,bases:array<string>,methods:array<string>,docstring:string,content:string>"
IMPORT = "struct<type:string,lineno:int,module:string,name:string,alias:string,level:int>"
SYMBOL = "struct<name:string,symbol_type:string,start_line:int,end_line:int,signature:string,docstring:string>"
DEEP_SYMBOL = (
    "struct<symbol_name:string,symbol_type:string,start_line:int,end_line:int,signature:string,docstring:string,decorators:array<string>,"
    "parameters:array<struct<name:string,annotation:string,default_value:string>>,return_type:string,base_classes:array<string>,methods:array<string>,"
    "imports_used:array<struct<module_name:string,symbol_name:string,alias:string,import_type:string>>,"
    "functions_called:array<struct<function_name:string,arguments:array<string>,is_method_call:boolean,object_name:string>>,"
    "cyclomatic_complexity:int,lines_of_code:int>"
)
FEATURES = "struct<parseable:boolean,calls:array<string>,imports:array<string>,return_style:string,has_try_except:boolean,raises:boolean,parameter_count:int>"
EXTRACTED = f"path string, parse_error string, functions array<{FUNCTION}>, classes array<{CLASS}>, imports array<{IMPORT}>, symbols array<{SYMBOL}>, deep array<{DEEP_SYMBOL}>"

NODES = "id string, label string, name string, path string, start_line int, end_line int, signature string, content string, updated_at timestamp"
EDGES = "src string, dst string, type string, count long, updated_at timestamp"
TRACE = "events array<struct<event:string,func:string,module:string,line:int,depth:int,arg_types:array<string>>>, call_counts map<string,bigint>, exit_code int"
COVERAGE = "files map<string,struct<executed_lines:array<int>,missing_lines:array<int>,excluded_lines:array<int>>>"
CHANGES = "file_path string, change_type string, ts timestamp, old_path string, content string"
HUNK = "struct<header:string,oldStart:int,oldLines:int,newStart:int,newLines:int,changedOldLines:array<int>,changedNewLines:array<int>>"
CHANGED_SYMBOL = "struct<name:string,type:string,startLine:int,endLine:int,changedLines:array<int>,content:string,filePath:string>"
STAGED = f"path string, status string, language string, additions int, deletions int, oldContent string, newContent string, hunks array<{HUNK}>, changedSymbols array<{CHANGED_SYMBOL}>"
FINDINGS = "severity string, affected_file string, affected_symbol string, reason string, matched_pattern string, suggested_fix string, validation_status string"
LINT = "array<struct<filename:string,location:struct<row:int,column:int>,code:string,message:string>>"

SEVERITIES = ("info", "note", "warning", "error", "blocker")
