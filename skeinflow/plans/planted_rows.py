"""The rows that the queries over the planted source tree must give, checked against the rules one by one."""

ROWS = {
    "planted_symbols": (
        "path varchar, kind varchar, name varchar, class_name varchar, line int, line_end int",
        [
            ('app/agents.py', 'class', 'Base', None, 4, 6),
            ('app/agents.py', 'class', 'Planner', None, 7, 15),
            ('app/agents.py', 'class', 'Quiet', None, 16, 18),
            ('app/agents.py', 'function', 'check_text', None, 21, 22),
            ('app/agents.py', 'function', 'inner', None, 11, 12),
            ('app/agents.py', 'function', 'listing', None, 23, 25),
            ('app/agents.py', 'function', 'start', None, 19, 20),
            ('app/agents.py', 'method', 'plan', 'Planner', 14, 15),
            ('app/agents.py', 'method', 'run', 'Planner', 9, 13),
            ('app/agents.py', 'method', 'run', 'Quiet', 17, 18),
            ('app/agents.py', 'method', 'shell', 'Base', 5, 6),
            ('app/helper.py', 'class', 'Assistant', None, 2, 4),
            ('app/helper.py', 'class', 'Explorer', None, 5, 8),
            ('app/helper.py', 'function', 'boot', None, 9, 10),
            ('app/helper.py', 'method', 'answer', 'Assistant', 3, 4),
            ('app/helper.py', 'method', 'tools', 'Explorer', 6, 8),
            ('app/mcp/servers/mail/server.py', 'function', '_hidden', None, 7, 7),
            ('app/mcp/servers/mail/server.py', 'function', 'fetch_mail', None, 5, 6),
            ('app/mcp/servers/mail/server.py', 'function', 'send_mail', None, 2, 4),
            ('app/page.py', 'function', 'on_send', None, 3, 5),
            ('app/readers.py', 'class', 'Viewer', None, 2, 6),
            ('app/readers.py', 'function', 'spawn', None, 7, 8),
            ('app/readers.py', 'function', 'stash', None, 9, 10),
            ('app/readers.py', 'method', 'refresh', 'Viewer', 5, 6),
            ('app/readers.py', 'method', 'render', 'Viewer', 3, 4),
            ('app/tools.py', 'function', 'catalogue', None, 9, 10),
            ('app/tools.py', 'function', 'save', None, 4, 6),
            ('app/tools.py', 'function', 'save_fixed', None, 7, 8),
            ('app/tools.py', 'function', 'search', None, 1, 3),
            ('app/web.py', 'function', 'ask', None, 13, 14),
            ('app/web.py', 'function', 'django_view', None, 21, 23),
            ('app/web.py', 'function', 'flask_view', None, 16, 19),
            ('app/web.py', 'function', 'keep', None, 10, 11),
            ('app/web.py', 'function', 'listed', None, 25, 26),
            ('app/web.py', 'function', 'no_literal', None, 31, 32),
            ('app/web.py', 'function', 'upload', None, 7, 9),
            ('app/web.py', 'function', 'ws', None, 28, 29),
            ('chain.py', 'class', 'Audit', None, 14, 15),
            ('chain.py', 'function', 'look', None, 10, 11),
            ('low.py', 'class', 'Host', None, 2, 4),
            ('low.py', 'function', 'call', None, 7, 8),
            ('low.py', 'method', '__init__', 'Host', 3, 4),
            ('objects.py', 'function', 'down', None, 7, 15),
            ('objects.py', 'function', 'up', None, 4, 6),
            ('shared_tools.py', 'function', 'shared', None, 3, 4),
            ('srv.py', 'class', 'Gate', None, 4, 5),
            ('srv.py', 'function', 'read_file', None, 8, 9),
        ],
    ),
    "planted_capabilities": (
        "path varchar, kind varchar, name varchar, class_name varchar, caps varchar",
        [
            ('app/agents.py', 'class', 'Base', None, 'executes_code+executes_shell'),
            ('app/agents.py', 'class', 'Planner', None, 'calls_llm+reads_env+reads_secrets+reads_untrusted'),
            ('app/agents.py', 'function', 'inner', None, 'reads_untrusted'),
            ('app/agents.py', 'function', 'listing', None, 'reads_filesystem+reads_untrusted'),
            ('app/agents.py', 'method', 'plan', 'Planner', 'calls_llm'),
            ('app/agents.py', 'method', 'run', 'Planner', 'calls_llm+reads_untrusted'),
            ('app/agents.py', 'method', 'shell', 'Base', 'executes_code+executes_shell'),
            ('app/helper.py', 'class', 'Assistant', None, 'calls_llm'),
            ('app/helper.py', 'class', 'Explorer', None, 'calls_llm+reads_untrusted'),
            ('app/helper.py', 'method', 'answer', 'Assistant', 'calls_llm'),
            ('app/helper.py', 'method', 'tools', 'Explorer', 'calls_llm+reads_untrusted'),
            ('app/mcp/servers/mail/server.py', 'function', 'fetch_mail', None, 'reads_untrusted'),
            ('app/mcp/servers/mail/server.py', 'function', 'send_mail', None, 'writes_email_inbox'),
            ('app/page.py', 'function', 'on_send', None, 'writes_filesystem'),
            ('app/readers.py', 'class', 'Viewer', None, 'reads_filesystem'),
            ('app/readers.py', 'function', 'spawn', None, 'executes_code+reads_filesystem'),
            ('app/readers.py', 'function', 'stash', None, 'writes_filesystem'),
            ('app/readers.py', 'method', 'refresh', 'Viewer', 'reads_filesystem'),
            ('app/readers.py', 'method', 'render', 'Viewer', 'reads_filesystem'),
            ('app/tools.py', 'function', 'catalogue', None, 'writes_filesystem'),
            ('app/tools.py', 'function', 'save', None, 'writes_db'),
            ('app/tools.py', 'function', 'save_fixed', None, 'writes_db'),
            ('app/tools.py', 'function', 'search', None, 'reads_db'),
            ('app/web.py', 'function', 'django_view', None, 'writes_filesystem'),
            ('app/web.py', 'function', 'flask_view', None, 'writes_filesystem'),
            ('app/web.py', 'function', 'keep', None, 'writes_filesystem'),
            ('chain.py', 'function', 'look', None, 'http_egress'),
            ('objects.py', 'function', 'down', None, 'reads_filesystem'),
            ('shared_tools.py', 'function', 'shared', None, 'reads_env'),
            ('srv.py', 'function', 'read_file', None, 'reads_filesystem'),
        ],
    ),
    "planted_symbol_lookup": (
        "path varchar, name varchar, caps varchar",
        [
            ('app/agents.py', 'Base', 'executes_code+executes_shell'),
            ('app/agents.py', 'Planner', 'calls_llm+reads_env+reads_secrets+reads_untrusted'),
            ('app/agents.py', 'Quiet', ''),
            ('app/agents.py', 'inner', 'reads_untrusted'),
            ('app/agents.py', 'listing', 'reads_filesystem+reads_untrusted'),
            ('app/agents.py', 'plan', 'calls_llm'),
            ('app/agents.py', 'run', 'calls_llm+reads_untrusted'),
            ('app/agents.py', 'shell', 'executes_code+executes_shell'),
            ('app/helper.py', 'Assistant', 'calls_llm'),
            ('app/helper.py', 'Explorer', 'calls_llm+reads_untrusted'),
            ('app/helper.py', 'answer', 'calls_llm'),
            ('app/helper.py', 'tools', 'calls_llm+reads_untrusted'),
            ('app/mcp/servers/mail/server.py', 'fetch_mail', 'reads_untrusted'),
            ('app/mcp/servers/mail/server.py', 'send_mail', 'writes_email_inbox'),
            ('app/page.py', 'on_send', 'writes_filesystem'),
            ('app/readers.py', 'Viewer', 'reads_filesystem'),
            ('app/readers.py', 'refresh', 'reads_filesystem'),
            ('app/readers.py', 'render', 'reads_filesystem'),
            ('app/readers.py', 'spawn', 'executes_code+reads_filesystem'),
            ('app/readers.py', 'stash', 'writes_filesystem'),
            ('app/tools.py', 'catalogue', 'writes_filesystem'),
            ('app/tools.py', 'save', 'writes_db'),
            ('app/tools.py', 'save_fixed', 'writes_db'),
            ('app/tools.py', 'search', 'reads_db'),
            ('app/web.py', 'django_view', 'writes_filesystem'),
            ('app/web.py', 'flask_view', 'writes_filesystem'),
            ('app/web.py', 'keep', 'writes_filesystem'),
            ('chain.py', 'Audit', ''),
            ('chain.py', 'look', 'http_egress'),
            ('low.py', 'Host', ''),
            ('objects.py', 'down', 'reads_filesystem'),
            ('shared_tools.py', 'shared', 'reads_env'),
            ('srv.py', 'Gate', ''),
            ('srv.py', 'read_file', 'reads_filesystem'),
        ],
    ),
    "planted_module_capabilities": (
        "path varchar, caps varchar",
        [
            ('app/agents.py', 'http_egress'),
        ],
    ),
    "planted_entries": (
        "path varchar, kind varchar, handler varchar, method varchar, target varchar, line int",
        [
            ('app/page.py', 'page', '<module>', None, 'button', 6),
            ('app/page.py', 'page', '<module>', None, 'file_uploader', 7),
            ('app/web.py', 'http', 'ask', 'GET', '/ask/{q}', 13),
            ('app/web.py', 'http', 'django_view', 'POST', '', 21),
            ('app/web.py', 'http', 'flask_view', 'PUT', '/flask', 16),
            ('app/web.py', 'http', 'listed', 'GET', '', 25),
            ('app/web.py', 'http', 'upload', 'POST', '/upload', 7),
            ('app/web.py', 'http', 'ws', 'WS', '/ws', 28),
            ('run.py', 'cli', '<module>', None, None, 3),
        ],
    ),
    "planted_call_graph": (
        "caller varchar, callee varchar",
        [
            ('__init__', 'Server'),
            ('ask', 'start'),
            ('boot', 'Assistant'),
            ('catalogue', 'open'),
            ('down', 'Minio'),
            ('down', 'Path'),
            ('flask_view', 'open'),
            ('keep', 'open'),
            ('listed', 'api_view'),
            ('listed', 'boot'),
            ('listing', 'create_mcp_server'),
            ('listing', 'open'),
            ('on_send', 'open'),
            ('on_send', 'save'),
            ('plan', 'check_text'),
            ('read_file', 'open'),
            ('refresh', 'open'),
            ('render', 'open'),
            ('search', 'save'),
            ('send_mail', 'save'),
            ('spawn', 'open'),
            ('start', 'Planner'),
            ('stash', 'open'),
            ('tools', 'create_mcp_server'),
            ('upload', 'Form'),
            ('upload', 'Planner'),
            ('upload', 'keep'),
            ('ws', 'Assistant'),
        ],
    ),
    "planted_untrusted_reads": (
        "path varchar, source_type varchar, call_target varchar, line int, reader varchar, container varchar",
        [
            ('app/agents.py', 'mcp_tool_description', 'client.list_tools', 25, 'listing', None),
            ('app/agents.py', 'rag_corpus', 'collection.query', 12, 'run', 'Planner'),
            ('app/helper.py', 'mcp_tool_description', 'client.list_tools', 7, 'tools', 'Explorer'),
            ('app/mcp/servers/mail/server.py', 'email_inbox', 'imap.fetch', 6, 'fetch_mail', None),
        ],
    ),
    "planted_store_sites": (
        "path varchar, family varchar, side varchar, hint varchar, line int",
        [
            ('app/agents.py', 'fs', 'read', 'data/tools.json', 25),
            ('app/page.py', 'fs', 'write', 'data/page.txt', 5),
            ('app/readers.py', 'fs', 'read', 'data/flask.bin', 4),
            ('app/readers.py', 'fs', 'read', 'data/flask.bin', 8),
            ('app/readers.py', 'fs', 'read', None, 6),
            ('app/readers.py', 'fs', 'write', None, 10),
            ('app/tools.py', 'db', 'read', 'notes', 2),
            ('app/tools.py', 'db', 'write', 'notes', 5),
            ('app/tools.py', 'fs', 'write', 'data/tools.json', 10),
            ('app/web.py', 'fs', 'write', 'data/flask.bin', 18),
            ('app/web.py', 'fs', 'write', 'data/uploads/', 11),
            ('objects.py', 'db', 'write', 'notes', 14),
            ('objects.py', 'fs', 'read', 'data/flask.bin', 13),
            ('objects.py', 's3', 'read', 'cold/a', 11),
            ('objects.py', 's3', 'read', 'raw/', 12),
            ('objects.py', 's3', 'read', 'raw/in/x', 9),
            ('objects.py', 's3', 'write', 'raw/in/', 5),
            ('objects.py', 's3', 'write', 'raw/in/fixed', 6),
            ('srv.py', 'fs', 'read', None, 9),
        ],
    ),
    "planted_store_links": (
        "path varchar, family varchar, side varchar, hint varchar, line int, key varchar, confidence double",
        [
            ('app/agents.py', 'fs', 'read', 'data/tools.json', 25, 'data/tools.json', 0.748),
            ('app/page.py', 'fs', 'write', 'data/page.txt', 5, 'data/page.txt', 0.72),
            ('app/readers.py', 'fs', 'read', 'data/flask.bin', 4, 'data/flask.bin', 0.776),
            ('app/readers.py', 'fs', 'read', 'data/flask.bin', 8, 'data/flask.bin', 0.776),
            ('app/readers.py', 'fs', 'read', None, 6, 'data/flask.bin', 0.552),
            ('app/readers.py', 'fs', 'read', None, 6, 'data/page.txt', 0.552),
            ('app/readers.py', 'fs', 'read', None, 6, 'data/tools.json', 0.552),
            ('app/readers.py', 'fs', 'read', None, 6, 'data/uploads/', 0.552),
            ('app/readers.py', 'fs', 'write', None, 10, 'data/flask.bin', 0.552),
            ('app/readers.py', 'fs', 'write', None, 10, 'data/page.txt', 0.552),
            ('app/readers.py', 'fs', 'write', None, 10, 'data/tools.json', 0.552),
            ('app/readers.py', 'fs', 'write', None, 10, 'data/uploads/', 0.552),
            ('app/tools.py', 'db', 'read', 'notes', 2, 'notes', 0.776),
            ('app/tools.py', 'db', 'write', 'notes', 5, 'notes', 0.776),
            ('app/tools.py', 'fs', 'write', 'data/tools.json', 10, 'data/tools.json', 0.748),
            ('app/web.py', 'fs', 'write', 'data/flask.bin', 18, 'data/flask.bin', 0.748),
            ('app/web.py', 'fs', 'write', 'data/uploads/', 11, 'data/uploads/', 0.748),
            ('objects.py', 'db', 'write', 'notes', 14, 'notes', 0.72),
            ('objects.py', 'fs', 'read', 'data/flask.bin', 13, 'data/flask.bin', 0.72),
            ('objects.py', 's3', 'read', 'cold/a', 11, 'cold/a', 0.72),
            ('objects.py', 's3', 'read', 'raw/', 12, 'raw/', 0.776),
            ('objects.py', 's3', 'read', 'raw/', 12, 'raw/in/', 0.608),
            ('objects.py', 's3', 'read', 'raw/', 12, 'raw/in/fixed', 0.608),
            ('objects.py', 's3', 'read', 'raw/', 12, 'raw/in/x', 0.608),
            ('objects.py', 's3', 'read', 'raw/in/x', 9, 'raw/', 0.608),
            ('objects.py', 's3', 'read', 'raw/in/x', 9, 'raw/in/', 0.608),
            ('objects.py', 's3', 'read', 'raw/in/x', 9, 'raw/in/x', 0.776),
            ('objects.py', 's3', 'write', 'raw/in/', 5, 'raw/', 0.608),
            ('objects.py', 's3', 'write', 'raw/in/', 5, 'raw/in/', 0.776),
            ('objects.py', 's3', 'write', 'raw/in/', 5, 'raw/in/fixed', 0.608),
            ('objects.py', 's3', 'write', 'raw/in/', 5, 'raw/in/x', 0.608),
            ('objects.py', 's3', 'write', 'raw/in/fixed', 6, 'raw/', 0.608),
            ('objects.py', 's3', 'write', 'raw/in/fixed', 6, 'raw/in/', 0.608),
            ('objects.py', 's3', 'write', 'raw/in/fixed', 6, 'raw/in/fixed', 0.776),
            ('srv.py', 'fs', 'read', None, 9, 'data/flask.bin', 0.44),
            ('srv.py', 'fs', 'read', None, 9, 'data/page.txt', 0.44),
            ('srv.py', 'fs', 'read', None, 9, 'data/tools.json', 0.44),
            ('srv.py', 'fs', 'read', None, 9, 'data/uploads/', 0.44),
        ],
    ),
    "planted_sink_flows": (
        "path varchar, kind varchar, name varchar, grade varchar, evidence varchar",
        [
            ('app/agents.py', 'class', 'Base', 'parameter_match', 'method:shell+cmd+literal'),
            ('app/agents.py', 'function', 'shell', 'parameter_match', 'cmd+literal'),
            ('app/page.py', 'function', 'on_send', 'literal_only', 'literal+literal'),
            ('app/readers.py', 'function', 'spawn', 'parameter_match', 'call'),
            ('app/readers.py', 'function', 'stash', 'parameter_match', 'x.path+literal'),
            ('app/tools.py', 'function', 'catalogue', 'literal_only', 'literal+literal'),
            ('app/tools.py', 'function', 'save', 'parameter_match', 'commit of parameters'),
            ('app/tools.py', 'function', 'save_fixed', 'literal_only', 'literal'),
            ('app/web.py', 'function', 'django_view', 'literal_only', 'literal'),
            ('app/web.py', 'function', 'flask_view', 'literal_only', 'literal+literal'),
            ('chain.py', 'function', 'look', 'parameter_match', 'q'),
        ],
    ),
    "planted_call_flows": (
        "path varchar, scope varchar, callee varchar, line int, grade varchar, flow_kind varchar, evidence varchar",
        [
            ('app/agents.py', 'check_text', 'strip', 22, 'no_args', 'control', ''),
            ('app/agents.py', 'inner', 'query', 12, 'parameter_match', 'data', 'x'),
            ('app/agents.py', 'listing', 'create_mcp_server', 24, 'literal_only', 'control', 'literal'),
            ('app/agents.py', 'listing', 'list_tools', 25, 'call_result_match', 'data', 'call'),
            ('app/agents.py', 'listing', 'open', 25, 'literal_only', 'control', 'literal'),
            ('app/agents.py', 'plan', 'check_text', 15, 'parameter_match', 'data', 'q'),
            ('app/agents.py', 'plan', 'create', 15, 'call_result_match', 'data', 'call'),
            ('app/agents.py', 'run', 'check_text', 10, 'parameter_match', 'data', 'q'),
            ('app/agents.py', 'run', 'create', 13, 'call_result_match', 'data', 'call'),
            ('app/agents.py', 'run', 'inner', 13, 'parameter_match', 'data', 'q'),
            ('app/agents.py', 'shell', 'run', 6, 'parameter_match', 'data', 'cmd+literal'),
            ('app/agents.py', 'start', 'Planner', 20, 'parameter_match', 'data', 'q'),
            ('app/helper.py', 'answer', 'create', 4, 'parameter_match', 'data', 'q'),
            ('app/helper.py', 'boot', 'Assistant', 10, 'parameter_match', 'data', 'q'),
            ('app/helper.py', 'tools', 'create', 7, 'call_result_match', 'data', 'call'),
            ('app/helper.py', 'tools', 'create_mcp_server', 8, 'literal_only', 'control', 'literal'),
            ('app/helper.py', 'tools', 'list_tools', 7, 'no_args', 'control', ''),
            ('app/mcp/servers/mail/server.py', 'fetch_mail', 'fetch', 6, 'literal_only', 'control', 'literal'),
            ('app/mcp/servers/mail/server.py', 'send_mail', 'save', 3, 'parameter_match', 'data', 'to'),
            ('app/mcp/servers/mail/server.py', 'send_mail', 'sendmail', 4, 'parameter_match', 'data', 'to'),
            ('app/page.py', 'on_send', 'open', 5, 'literal_only', 'control', 'literal+literal'),
            ('app/page.py', 'on_send', 'save', 4, 'parameter_match', 'data', 'x'),
            ('app/readers.py', 'refresh', 'open', 6, 'unknown', 'control', 'self.path'),
            ('app/readers.py', 'render', 'open', 4, 'literal_only', 'control', 'literal'),
            ('app/readers.py', 'spawn', 'open', 8, 'literal_only', 'control', 'literal'),
            ('app/readers.py', 'spawn', 'run', 8, 'call_result_match', 'data', 'call'),
            ('app/readers.py', 'stash', 'open', 10, 'unknown', 'control', 'x.path+literal'),
            ('app/tools.py', 'catalogue', 'open', 10, 'literal_only', 'control', 'literal+literal'),
            ('app/tools.py', 'save', 'commit', 6, 'no_args', 'control', ''),
            ('app/tools.py', 'save', 'execute', 5, 'parameter_match', 'data', 'f-string'),
            ('app/tools.py', 'save_fixed', 'add', 8, 'literal_only', 'control', 'literal'),
            ('app/tools.py', 'search', 'execute', 2, 'literal_only', 'control', 'literal'),
            ('app/tools.py', 'search', 'save', 3, 'parameter_match', 'data', 'q'),
            ('app/web.py', 'ask', 'get', 12, 'literal_only', 'control', 'literal'),
            ('app/web.py', 'ask', 'start', 14, 'parameter_match', 'data', 'q'),
            ('app/web.py', 'django_view', 'get', 22, 'literal_only', 'control', 'literal'),
            ('app/web.py', 'django_view', 'remove', 23, 'literal_only', 'control', 'literal'),
            ('app/web.py', 'flask_view', 'open', 18, 'literal_only', 'control', 'literal+literal'),
            ('app/web.py', 'flask_view', 'route', 15, 'literal_only', 'control', 'literal+collection'),
            ('app/web.py', 'flask_view', 'write', 19, 'local_var_match', 'data', 'f'),
            ('app/web.py', 'keep', 'open', 11, 'unknown', 'control', 'expression+literal'),
            ('app/web.py', 'listed', 'api_view', 24, 'literal_only', 'control', 'collection'),
            ('app/web.py', 'listed', 'boot', 26, 'parameter_match', 'data', 'request'),
            ('app/web.py', 'no_literal', 'get', 30, 'unknown', 'control', 'PATH'),
            ('app/web.py', 'upload', 'Form', 7, 'no_args', 'control', ''),
            ('app/web.py', 'upload', 'Planner', 9, 'parameter_match', 'data', 'doc'),
            ('app/web.py', 'upload', 'keep', 8, 'parameter_match', 'data', 'doc'),
            ('app/web.py', 'upload', 'post', 6, 'literal_only', 'control', 'literal'),
            ('app/web.py', 'ws', 'Assistant', 29, 'parameter_match', 'data', 'c'),
            ('app/web.py', 'ws', 'websocket', 27, 'literal_only', 'control', 'literal'),
            ('chain.py', 'look', 'get', 11, 'parameter_match', 'data', 'q'),
            ('low.py', '__init__', 'Server', 4, 'literal_only', 'control', 'literal'),
            ('low.py', 'call', 'call_tool', 6, 'no_args', 'control', ''),
            ('objects.py', 'down', 'Minio', 10, 'literal_only', 'control', 'literal'),
            ('objects.py', 'down', 'Path', 13, 'literal_only', 'control', 'literal'),
            ('objects.py', 'down', 'S3FileSystem', 8, 'no_args', 'control', ''),
            ('objects.py', 'down', 'download_file', 12, 'parameter_match', 'data', 'literal+key+literal'),
            ('objects.py', 'down', 'executemany', 14, 'unknown', 'control', 'literal+rows'),
            ('objects.py', 'down', 'executemany', 15, 'unknown', 'control', 'literal+rows'),
            ('objects.py', 'down', 'get_object', 11, 'literal_only', 'control', 'literal+literal'),
            ('objects.py', 'down', 'open', 9, 'literal_only', 'control', 'literal+literal'),
            ('objects.py', 'up', 'put_object', 5, 'unknown', 'control', 'literal+expression'),
            ('objects.py', 'up', 'upload_file', 6, 'parameter_match', 'data', 'key+literal+literal'),
            ('shared_tools.py', 'shared', 'get', 4, 'literal_only', 'control', 'literal'),
            ('srv.py', 'read_file', 'open', 9, 'parameter_match', 'data', 'p'),
            ('srv.py', 'read_file', 'tool', 7, 'no_args', 'control', ''),
        ],
    ),
    "planted_inheritance": (
        "file varchar, name varchar, caps varchar",
        [
            ('app/agents.py', 'Base', 'executes_code+executes_shell'),
            ('app/agents.py', 'Planner', 'calls_llm+executes_code+executes_shell+reads_env+reads_secrets+reads_untrusted'),
            ('app/agents.py', 'Quiet', ''),
            ('app/helper.py', 'Assistant', 'calls_llm'),
            ('app/helper.py', 'Explorer', 'calls_llm+reads_untrusted'),
            ('app/readers.py', 'Viewer', 'reads_filesystem'),
            ('chain.py', 'Audit', ''),
            ('low.py', 'Host', ''),
            ('srv.py', 'Gate', ''),
        ],
    ),
    "planted_guardrail_capability": (
        "path varchar, name varchar",
        [
            ('app/agents.py', 'check_text'),
        ],
    ),
    "planted_server_usages": (
        "path varchar, handler varchar, server varchar, line int",
        [
            ('app/agents.py', 'listing', 'mail', 24),
            ('app/helper.py', 'tools', 'mail', 8),
        ],
    ),
    "planted_local_imports": (
        "path varchar, imports varchar",
        [
            ('app/agents.py', 'app/tools.py'),
            ('app/mcp/servers/mail/server.py', 'app/tools.py'),
            ('app/page.py', 'app/tools.py'),
            ('app/readers.py', 'app/web.py'),
            ('app/web.py', 'app/agents.py+app/helper.py'),
            ('chain.py', 'shared_tools.py'),
            ('run.py', 'app/tools.py'),
        ],
    ),
    "planted_components": (
        "framework varchar, kind varchar, name varchar, file varchar, parent varchar, detail varchar, capabilities varchar",
        [
            ('fastmcp', 'mcp_server', 'file-server', 'srv.py', None, None, ''),
            ('fastmcp', 'tool', 'read_file', 'srv.py', 'file-server', None, ''),
            ('fastmcp_middleware', 'guardrail', 'Gate', 'srv.py', None, None, ''),
            ('guardrails_ai', 'guardrail', 'shield', 'guards.py', None, None, ''),
            ('langchain', 'agent', 'AgentExecutor', 'chain.py', None, None, ''),
            ('langchain', 'agent', 'create_react_agent', 'chain.py', None, None, ''),
            ('langchain', 'llm_endpoint', 'ChatOpenAI', 'chain.py', None, 'openai', ''),
            ('langchain', 'tool', 'calc', 'chain.py', None, None, ''),
            ('langchain', 'tool', 'helper', 'chain.py', None, None, ''),
            ('langchain', 'tool', 'look', 'chain.py', None, 'parameter_match', 'http_egress'),
            ('langchain', 'tool', 'shared', 'shared_tools.py', None, 'no_args', 'reads_env'),
            ('langchain_callback', 'guardrail', 'Audit', 'chain.py', None, None, ''),
            ('langgraph', 'agent', 'plan', 'graph.py', None, None, ''),
            ('langgraph', 'agent', 'write', 'graph.py', None, None, ''),
            ('langgraph', 'tool', 'search_tools', 'graph.py', None, None, ''),
            ('mcp_python', 'mcp_server', 'low', 'low.py', None, None, ''),
            ('mcp_python', 'mcp_server', 'low-level', 'low.py', None, None, ''),
            ('mcp_python', 'tool', 'call', 'low.py', 'low', None, ''),
            ('nemo_guardrails', 'guardrail', 'LLMRails', 'guards.py', None, None, ''),
            ('nemo_guardrails', 'guardrail', 'rails', 'guards.py', None, None, ''),
        ],
    ),
    "planted_unclassified": (
        "path varchar, kind varchar, name varchar, class_name varchar, line int, has_tool boolean, parent_kind varchar",
        [
            ('app/agents.py', 'class', 'Quiet', None, 16, False, None),
            ('app/agents.py', 'method', 'plan', 'Planner', 14, False, 'sink'),
            ('app/agents.py', 'method', 'run', 'Planner', 9, False, 'sink'),
            ('app/agents.py', 'method', 'run', 'Quiet', 17, False, None),
            ('app/helper.py', 'method', 'answer', 'Assistant', 3, False, 'agent'),
            ('app/helper.py', 'method', 'tools', 'Explorer', 6, False, 'agent'),
            ('app/readers.py', 'class', 'Viewer', None, 2, False, None),
            ('app/readers.py', 'method', 'refresh', 'Viewer', 5, False, None),
            ('app/readers.py', 'method', 'render', 'Viewer', 3, False, None),
            ('low.py', 'class', 'Host', None, 2, False, None),
        ],
    ),
    "planted_model_answers": (
        "kind varchar, name varchar, file varchar, framework varchar, capabilities varchar",
        [
            ('agent', 'Assistant', 'app/helper.py', 'merged', 'calls_llm+reads_env'),
            ('agent', 'Viewer', 'app/readers.py', 'llm', 'reads_filesystem'),
            ('tool', 'Quiet', 'app/agents.py', 'llm', 'reads_db'),
        ],
    ),
    "planted_identity_answers": (
        "name varchar, identity_confidence double, via varchar",
        [
            ('fs:data/notes', None, None),
            ('writes_to', 0.2, 'llm'),
        ],
    ),
    "built_nodes": (
        "kind varchar, name varchar, file varchar, parent varchar, framework varchar, detail varchar, capabilities varchar, flow varchar, returns_data boolean, lethal_trifecta boolean",
        [
            ('agent', 'AgentExecutor', 'chain.py', None, 'langchain', None, '', None, None, False),
            ('agent', 'Assistant', 'app/helper.py', None, None, None, 'calls_llm', None, None, False),
            ('agent', 'Explorer', 'app/helper.py', None, None, None, 'calls_llm+reads_untrusted', None, None, False),
            ('agent', 'create_react_agent', 'chain.py', None, 'langchain', None, '', None, None, False),
            ('agent', 'plan', 'graph.py', None, 'langgraph', None, '', None, None, False),
            ('agent', 'write', 'graph.py', None, 'langgraph', None, '', None, None, False),
            ('entry_point', 'GET ', 'app/web.py', 'listed', None, 'http', '', None, None, False),
            ('entry_point', 'GET /ask/{q}', 'app/web.py', 'ask', None, 'http', '', None, None, False),
            ('entry_point', 'MCP:file-server', 'srv.py', None, 'fastmcp', 'mcp', '', None, None, False),
            ('entry_point', 'MCP:low', 'low.py', None, 'mcp_python', 'mcp', '', None, None, False),
            ('entry_point', 'MCP:low-level', 'low.py', None, 'mcp_python', 'mcp', '', None, None, False),
            ('entry_point', 'POST ', 'app/web.py', 'django_view', None, 'http', '', None, None, False),
            ('entry_point', 'POST /upload', 'app/web.py', 'upload', None, 'http', '', None, None, False),
            ('entry_point', 'PUT /flask', 'app/web.py', 'flask_view', None, 'http', '', None, None, False),
            ('entry_point', 'WS /ws', 'app/web.py', 'ws', None, 'http', '', None, None, False),
            ('entry_point', 'cli:run.py', 'run.py', '<module>', None, 'cli', '', None, None, False),
            ('entry_point', 'page:button', 'app/page.py', '<module>', None, 'page', '', None, None, False),
            ('entry_point', 'page:file_uploader', 'app/page.py', '<module>', None, 'page', '', None, None, False),
            ('guardrail', 'Audit', 'chain.py', None, 'langchain_callback', None, '', None, None, False),
            ('guardrail', 'Gate', 'srv.py', None, 'fastmcp_middleware', None, '', None, None, False),
            ('guardrail', 'LLMRails', 'guards.py', None, 'nemo_guardrails', None, '', None, None, False),
            ('guardrail', 'check_text', 'app/agents.py', None, None, None, 'validates_input', None, None, False),
            ('guardrail', 'rails', 'guards.py', None, 'nemo_guardrails', None, '', None, None, False),
            ('guardrail', 'shield', 'guards.py', None, 'guardrails_ai', None, '', None, None, False),
            ('llm_endpoint', 'ChatOpenAI', 'chain.py', None, 'langchain', 'openai', '', None, None, False),
            ('mcp_server', 'file-server', 'srv.py', None, 'fastmcp', None, '', None, None, False),
            ('mcp_server', 'low', 'low.py', None, 'mcp_python', None, '', None, None, False),
            ('mcp_server', 'low-level', 'low.py', None, 'mcp_python', None, '', None, None, False),
            ('mcp_server', 'mail', 'app/mcp/servers/mail/server.py', None, None, None, '', None, None, False),
            ('sink', 'Base', 'app/agents.py', None, None, None, 'executes_code+executes_shell', 'parameter_match', None, False),
            ('sink', 'Planner', 'app/agents.py', None, None, None, 'calls_llm+executes_code+executes_shell+reads_env+reads_secrets+reads_untrusted', 'unknown', None, True),
            ('sink', 'catalogue', 'app/tools.py', None, None, None, 'writes_filesystem', 'literal_only', None, False),
            ('sink', 'django_view', 'app/web.py', None, None, None, 'writes_filesystem', 'literal_only', None, False),
            ('sink', 'flask_view', 'app/web.py', None, None, None, 'writes_filesystem', 'literal_only', None, False),
            ('sink', 'keep', 'app/web.py', None, None, None, 'writes_filesystem', 'unknown', None, False),
            ('sink', 'on_send', 'app/page.py', None, None, None, 'writes_filesystem', 'literal_only', None, False),
            ('sink', 'save', 'app/tools.py', None, None, None, 'writes_db', 'parameter_match', None, False),
            ('sink', 'save_fixed', 'app/tools.py', None, None, None, 'writes_db', 'literal_only', None, False),
            ('sink', 'shell', 'app/agents.py', 'Base', None, None, 'executes_code+executes_shell', 'parameter_match', None, False),
            ('sink', 'spawn', 'app/readers.py', None, None, None, 'executes_code+reads_filesystem', 'parameter_match', None, False),
            ('sink', 'stash', 'app/readers.py', None, None, None, 'writes_filesystem', 'parameter_match', None, False),
            ('store', 'db:notes', None, 'notes', None, 'db', '', None, None, False),
            ('store', 'email_inbox:imap.fetch', None, 'imap.fetch', None, 'email_inbox', '', None, None, False),
            ('store', 'fs:data/flask.bin', None, 'data/flask.bin', None, 'fs', '', None, None, False),
            ('store', 'fs:data/page.txt', None, 'data/page.txt', None, 'fs', '', None, None, False),
            ('store', 'fs:data/tools.json', None, 'data/tools.json', None, 'fs', '', None, None, False),
            ('store', 'fs:data/uploads/', None, 'data/uploads/', None, 'fs', '', None, None, False),
            ('store', 'mcp_catalogue:mail', None, 'mail', None, 'mcp_catalogue', '', None, None, False),
            ('store', 's3:cold/a', None, 'cold/a', None, 's3', '', None, None, False),
            ('store', 's3:raw/', None, 'raw/', None, 's3', '', None, None, False),
            ('store', 's3:raw/in/', None, 'raw/in/', None, 's3', '', None, None, False),
            ('store', 's3:raw/in/fixed', None, 'raw/in/fixed', None, 's3', '', None, None, False),
            ('store', 's3:raw/in/x', None, 'raw/in/x', None, 's3', '', None, None, False),
            ('tool', 'calc', 'chain.py', None, 'langchain', None, '', None, None, False),
            ('tool', 'call', 'low.py', 'low', 'mcp_python', None, '', None, True, False),
            ('tool', 'fetch_mail', 'app/mcp/servers/mail/server.py', None, None, None, 'reads_untrusted', None, True, False),
            ('tool', 'helper', 'chain.py', None, 'langchain', None, '', None, None, False),
            ('tool', 'look', 'chain.py', None, 'langchain', 'parameter_match', 'http_egress', None, True, False),
            ('tool', 'read_file', 'srv.py', 'file-server', 'fastmcp', None, '', None, True, False),
            ('tool', 'search_tools', 'graph.py', None, 'langgraph', None, '', None, None, False),
            ('tool', 'send_mail', 'app/mcp/servers/mail/server.py', None, None, None, 'writes_email_inbox', None, False, False),
            ('tool', 'shared', 'shared_tools.py', None, 'langchain', 'no_args', 'reads_env', None, True, False),
            ('untrusted_source', 'email_inbox:imap.fetch', 'app/mcp/servers/mail/server.py', 'fetch_mail', None, 'email_inbox', '', None, None, False),
            ('untrusted_source', 'mcp_tool_description:client.list_tools', 'app/agents.py', 'listing', None, 'mcp_tool_description', '', None, None, False),
            ('untrusted_source', 'mcp_tool_description:client.list_tools', 'app/helper.py', 'tools', None, 'mcp_tool_description', '', None, None, False),
            ('untrusted_source', 'rag_corpus:collection.query', 'app/agents.py', 'run', None, 'rag_corpus', '', None, None, False),
            ('untrusted_source', 'user_upload:open', 'app/readers.py', None, None, 'user_upload', '', None, None, False),
        ],
    ),
    "built_edges": (
        "source varchar, kind varchar, target varchar, flow_kind varchar, identity_confidence double, via varchar",
        [
            ('agent:AgentExecutor', 'uses_model', 'llm_endpoint:ChatOpenAI', 'control', None, None),
            ('agent:AgentExecutor', 'uses_tool', 'tool:calc', 'control', None, None),
            ('agent:AgentExecutor', 'uses_tool', 'tool:shared', 'control', None, 'cross_file_import'),
            ('agent:Explorer', 'has_access_to', 'mcp_server:mail', 'control', None, None),
            ('agent:Explorer', 'uses_tool', 'tool:fetch_mail', 'control', None, None),
            ('agent:Explorer', 'uses_tool', 'tool:send_mail', 'control', None, None),
            ('agent:create_react_agent', 'uses_model', 'llm_endpoint:ChatOpenAI', 'control', None, None),
            ('agent:create_react_agent', 'uses_tool', 'tool:calc', 'control', None, None),
            ('agent:create_react_agent', 'uses_tool', 'tool:helper', 'control', None, None),
            ('agent:create_react_agent', 'uses_tool', 'tool:look', 'control', None, None),
            ('agent:create_react_agent', 'uses_tool', 'tool:shared', 'control', None, 'cross_file_import'),
            ('agent:plan', 'delegates_to', 'tool:search_tools', 'control', None, None),
            ('entry_point:GET ', 'delegates_to', 'agent:Assistant', 'control', None, 'call_graph'),
            ('entry_point:MCP:file-server', 'delegates_to', 'tool:read_file', 'control', None, 'mcp_entry'),
            ('entry_point:MCP:low', 'delegates_to', 'tool:call', 'control', None, 'mcp_entry'),
            ('entry_point:POST ', 'has_access_to', 'sink:django_view', 'control', None, None),
            ('entry_point:POST /upload', 'has_access_to', 'sink:keep', 'control', None, None),
            ('entry_point:POST /upload', 'writes_to', 'store:fs:data/uploads/', 'structural', 0.84, None),
            ('entry_point:PUT /flask', 'has_access_to', 'sink:flask_view', 'control', None, None),
            ('entry_point:PUT /flask', 'writes_to', 'store:fs:data/flask.bin', 'structural', 0.872, None),
            ('entry_point:WS /ws', 'delegates_to', 'agent:Assistant', 'control', None, 'call_graph'),
            ('entry_point:cli:run.py', 'has_access_to', 'sink:on_send', 'control', None, None),
            ('entry_point:page:file_uploader', 'writes_to', 'store:fs:data/page.txt', 'structural', 0.84, None),
            ('guardrail:Gate', 'guards', 'tool:read_file', 'structural', None, 'server'),
            ('mcp_server:mail', 'provides_tool', 'tool:fetch_mail', 'control', None, None),
            ('mcp_server:mail', 'provides_tool', 'tool:send_mail', 'control', None, None),
            ('mcp_server:mail', 'writes_to', 'store:mcp_catalogue:mail', 'structural', 0.8, None),
            ('sink:catalogue', 'writes_to', 'store:fs:data/tools.json', 'structural', 0.748, None),
            ('sink:flask_view', 'writes_to', 'store:fs:data/flask.bin', 'structural', 0.748, None),
            ('sink:keep', 'writes_to', 'store:fs:data/uploads/', 'structural', 0.748, None),
            ('sink:on_send', 'writes_to', 'store:fs:data/page.txt', 'structural', 0.72, None),
            ('sink:save', 'writes_to', 'store:db:notes', 'structural', 0.776, None),
            ('sink:stash', 'writes_to', 'store:fs:data/flask.bin', 'structural', 0.552, None),
            ('sink:stash', 'writes_to', 'store:fs:data/page.txt', 'structural', 0.552, None),
            ('sink:stash', 'writes_to', 'store:fs:data/tools.json', 'structural', 0.552, None),
            ('sink:stash', 'writes_to', 'store:fs:data/uploads/', 'structural', 0.552, None),
            ('store:email_inbox:imap.fetch', 'reads_from', 'untrusted_source:email_inbox:imap.fetch', 'structural', 0.776, None),
            ('store:fs:data/flask.bin', 'reads_from', 'untrusted_source:user_upload:open', 'structural', 0.748, None),
            ('store:fs:data/tools.json', 'reads_from', 'untrusted_source:mcp_tool_description:client.list_tools', 'structural', 0.748, None),
            ('store:mcp_catalogue:mail', 'reads_from', 'untrusted_source:mcp_tool_description:client.list_tools', 'structural', 0.8, None),
            ('store:mcp_catalogue:mail', 'reads_from', 'untrusted_source:mcp_tool_description:client.list_tools', 'structural', 0.8, None),
            ('tool:search_tools', 'delegates_to', 'agent:plan', 'control', None, None),
            ('tool:search_tools', 'delegates_to', 'agent:write', 'control', None, None),
            ('tool:send_mail', 'has_access_to', 'sink:save', 'control', None, None),
            ('tool:send_mail', 'writes_to', 'store:email_inbox:imap.fetch', 'structural', 0.776, None),
            ('untrusted_source:email_inbox:imap.fetch', 'has_access_to', 'tool:fetch_mail', 'control', None, None),
            ('untrusted_source:mcp_tool_description:client.list_tools', 'has_access_to', 'agent:Explorer', 'control', None, None),
            ('untrusted_source:rag_corpus:collection.query', 'has_access_to', 'sink:Planner', 'control', None, None),
        ],
    ),
}
