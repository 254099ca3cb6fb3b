"""Built-in rule packs, as data.

``secrets`` is worded here from its description: key material is out of reach, and
sessions that read .env files are labelled private-data.
"""

from __future__ import annotations

# Rule ids, patterns, actions and reasons of the packs, in order.
# A rule is (id, tool, conditions, action, reason); a condition is (path, {matcher: value}).
SHELL = "args.{command,cmd,script,code,input}"
SQL = "args.{sql,query,statement}"

PACKS: dict[str, dict] = {}

PACKS['ask-destructive'] = {
    "rules": [
        ('server-says-destructive', '*', [('annotations.read_only', {'equals': False}), ('annotations.destructive', {'equals': True})], 'ask', 'the server marks this tool as destructive'),
    ],
}

PACKS['baseline'] = {
    "rules": [
        ('rm-rf-root', '*', [(SHELL, {'shell_regex': r"""(?i)\brm\s+(-[a-z]*r[a-z]*f[a-z]*|-[a-z]*f[a-z]*r[a-z]*|(--recursive|-r)\s+(--force|-f)|(--force|-f)\s+(--recursive|-r))\s+(--no-preserve-root\s+)?["']?(/|~|\$HOME|\*|\.\.?)/?\*?["']?(\s|;|&|\||$)"""})], 'deny', 'recursive force delete of a root, home, current or wildcard path'),
        ('disk-wipe', '*', [(SHELL, {'shell_regex': r"""(?i)(\bmkfs(\.\w+)?\s|\bdd\s+[^;&|]*\bof=/dev/(sd|nvme|hd|disk|mmcblk|xvd)|>\s*/dev/(sd|nvme|hd|disk|xvd)[a-z0-9]*\b|:\(\)\s*\{\s*:\s*\|\s*:\s*&\s*\}\s*;\s*:|\bshred\s+[^;&|]*/dev/|\bwipefs\b)"""})], 'deny', 'this wipes a disk or forks the machine to death'),
        ('chmod-root', '*', [(SHELL, {'shell_regex': r"""(?i)\bch(mod|own|grp)\s+(-[a-z]*R[a-z]*|--recursive)\s+\S+\s+["']?/["']?(\s|;|&|\||$)"""})], 'deny', 'recursive permission change on the root directory'),
        ('pipe-to-shell', '*', [(SHELL, {'shell_regex': r"""(?i)\b(curl|wget|fetch)\b[^;&]*\|\s*(sudo\s+)?(ba|z|k|da)?sh\b"""})], 'ask', 'this runs a script straight from the internet'),
        ('git-force-push-main', '*', [(SHELL, {'shell_regex': r"""(?i)\bgit\s+push\b[^;&|]*\s(-f|--force|--force-with-lease)\b[^;&|]*\b(main|master)\b|\bgit\s+push\b[^;&|]*\b(main|master)\b[^;&|]*\s(-f|--force|--force-with-lease)\b|\bgit\s+push\b[^;&|]*\s\+(main|master)\b"""})], 'deny', 'force-pushing main rewrites history everyone else has'),
        ('git-force-push', '*', [(SHELL, {'shell_regex': r"""(?i)\bgit\s+push\b[^;&|]*\s(-f|--force|--force-with-lease)\b"""})], 'ask', 'a force-push rewrites history on the remote'),
        ('git-discard-work', '*', [(SHELL, {'shell_regex': r"""(?i)\bgit\s+(reset\s+--hard|clean\s+-[a-z]*f|checkout\s+--\s+\.|restore\s+(--staged\s+)?\.(\s|$)|stash\s+(drop|clear))"""})], 'ask', 'this throws away uncommitted work'),
        ('sql-drop', '*', [('args.{sql,query,statement,command,cmd}', {'sql_regex': r"""(?i)\b(drop\s+(table|database|schema|view|index|user|role)|truncate\s+(table\s+)?[\w."`]+)"""})], 'deny', 'dropping or truncating is not for agents'),
        ('sql-delete-everything', '*', [(SQL, {'sql_regex': r"""(?i)\bdelete\s+from\b"""}), (SQL, {'not_sql_regex': r"""(?i)\bwhere\b"""})], 'deny', 'a DELETE without a WHERE clause empties the table'),
        ('sql-update-everything', '*', [(SQL, {'sql_regex': r"""(?i)\bupdate\s+[\w."`]+\s+set\b"""}), (SQL, {'not_sql_regex': r"""(?i)\bwhere\b"""})], 'deny', 'an UPDATE without a WHERE clause rewrites every row'),
    ],
}

PACKS['business-hours'] = {
    "params": {'first_hour': {'default': '8'}, 'last_hour': {'default': '17'}},
    "rules": [
        ('weekend', '*', [('time.weekday', {'in': ['saturday', 'sunday']}), ('tool_name', {'regex': '(?i)(write|edit|create|update|delete|remove|move|rename|push|merge|deploy|release|publish|send|post|exec|run|execute|apply|drop|insert)'})], 'ask', 'it is the weekend; changes wait for a human'),
        ('before-hours', '*', [('time.hour', {'lt': '{{first_hour}}'}), ('tool_name', {'regex': '(?i)(write|edit|create|update|delete|remove|move|rename|push|merge|deploy|release|publish|send|post|exec|run|execute|apply|drop|insert)'})], 'ask', 'outside working hours; changes wait for a human'),
        ('after-hours', '*', [('time.hour', {'gt': '{{last_hour}}'}), ('tool_name', {'regex': '(?i)(write|edit|create|update|delete|remove|move|rename|push|merge|deploy|release|publish|send|post|exec|run|execute|apply|drop|insert)'})], 'ask', 'outside working hours; changes wait for a human'),
    ],
}

PACKS['database'] = {
    "rules": [
        ('schema-change', '*', [(SQL, {'sql_regex': r"""(?i)(^|;)\s*(alter|create|grant|revoke|comment\s+on|reindex|cluster|rename)\b"""})], 'ask', 'this changes the schema or permissions'),
        ('write', '*', [(SQL, {'sql_regex': r"""(?i)\b(insert\s+into|update\s+[\w."`]+\s+set|delete\s+from|merge\s+into|upsert|replace\s+into|copy\s+[\w."`]+\s+from|load\s+data)\b"""})], 'ask', 'this writes to the database'),
    ],
}

PACKS['filesystem'] = {
    "params": {'workspace': {'required': True, 'path': True}},
    "rules": [
        ('write-outside-workspace', '*', [('tool_name', {'regex': '(?i)(write|edit|create|move|rename|delete|remove|append|patch|replace|mkdir|copy|upload|save)'}), ('args.{path,file_path,filePath,destination,target,dest,new_path,newPath,to}', {'regex': r"""^(/|~|[A-Za-z]:[\\/])"""}), ('args.{path,file_path,filePath,destination,target,dest,new_path,newPath,to}', {'not_path_prefix': '{{workspace}}'})], 'deny', 'writes are confined to {{workspace}}'),
        ('climb-out', '*', [('tool_name', {'regex': '(?i)(write|edit|create|move|rename|delete|remove|append|patch|replace|mkdir|copy|upload|save)'}), ('args.{path,file_path,filePath,source,destination,target,dest,new_path,newPath,to}', {'regex': r"""(^|[/\\])\.\.([/\\]|$)"""})], 'deny', 'a path that climbs out with .. could land anywhere'),
    ],
}

PACKS['git-safety'] = {
    "rules": [
        ('push-main', '*', [(SHELL, {'shell_regex': r"""(?i)\bgit\s+push\b[^;&|]*\b(main|master)\b"""})], 'ask', 'this pushes straight to main'),
        ('push-tags', '*', [(SHELL, {'shell_regex': r"""(?i)\bgit\s+push\b[^;&|]*(--tags|--follow-tags|refs/tags/)"""})], 'ask', 'pushed tags are hard to take back'),
        ('delete-branch', '*', [(SHELL, {'shell_regex': r"""(?i)\bgit\s+(branch\s+(-D|--delete\s+--force|-d\s+-f)|push\s+[^;&|]*(--delete|\s:[^\s;&|]+))"""})], 'ask', 'this deletes a branch'),
        ('rewrite-history', '*', [(SHELL, {'shell_regex': r"""(?i)\bgit\s+(filter-branch|filter-repo|reflog\s+(expire|delete)|update-ref\s+-d|replace\s|rebase\s+[^;&|]*\b(main|master)\b)"""})], 'ask', 'this rewrites history'),
        ('global-config', '*', [(SHELL, {'shell_regex': r"""(?i)\bgit\s+config\s+(--global|--system)\b"""})], 'ask', 'this changes git configuration outside the repository'),
    ],
}

PACKS['github'] = {
    "rules": [
        ('delete-repository', '*', [('tool_name', {'regex': '(?i)^(delete_repository|delete_repo|repo_delete|delete_project)$'})], 'deny', 'an agent does not delete repositories'),
        ('merge', '*', [('tool_name', {'regex': '(?i)merge_(pull_request|merge_request|pr)|^merge$'})], 'ask', 'merging changes the default branch'),
        ('default-branch-write', '*', [('tool_name', {'regex': '(?i)^(create_or_update_file|push_files|delete_file|update_file|create_file|create_commit)$'}), ('args.{branch,ref}', {'in': ['main', 'master']})], 'ask', 'this writes straight to the default branch'),
        ('settings', '*', [('tool_name', {'regex': '(?i)(update_repository|update_repo|create_repository|fork_repository|transfer_repository|add_collaborator|remove_collaborator|update_branch_protection|delete_branch|create_release|update_release|delete_release|create_deploy_key|create_or_update_secret|set_secret|delete_secret|create_webhook|update_webhook|delete_webhook|archive_repository)'})], 'ask', 'this changes how the repository is set up'),
        ('public-writes', '*', [('tool_name', {'regex': '(?i)^(create_issue|update_issue|close_issue|add_issue_comment|create_comment|create_pull_request|update_pull_request|close_pull_request|create_pull_request_review|submit_pending_pull_request_review|add_comment_to_pending_review|create_discussion|add_discussion_comment|create_gist|update_gist)$'})], 'ask', 'other people will see this'),
    ],
}

PACKS['lethal-trifecta'] = {
    "labels": [
        ('untrusted-input', '*', [('tool_name', {'regex': '(?i)(fetch|browse|navigate|scrape|crawl|web_?search|search_web|read_url|get_url|open_url|http_get|download|get_issue|list_issues|search_issues|issue_read|get_pull_request|list_pull_requests|get_comments|read_email|get_email|list_emails|search_emails|get_message|list_messages|read_message|get_page|read_page|screenshot)'})]),
        ('private-data', '*', [('args.{path,paths,file,files,file_path,filePath,filename,command,cmd}', {'regex': r"""(?i)(\.env\b|secret|credential|token|\.ssh/|\.aws/|passw)"""})]),
    ],
    "rules": [
        ('injected-egress', '*', [('session.label.injection-suspected', {'equals': True}), ('tool_name', {'regex': '(?i)(send|post|publish|upload|email|mail|message|comment|reply|create|update|push|webhook|request|fetch|http|navigate|browse|share|exec|run|command)'})], 'deny', 'suspected prompt injection: a tool result this session read carried hidden text or instructions aimed at the model, so nothing leaves the session now'),
        ('trifecta', '*', [('session.label.untrusted-input', {'equals': True}), ('session.label.private-data', {'equals': True}), ('tool_name', {'regex': '(?i)(send|post|publish|upload|email|mail|message|comment|reply|create|update|push|webhook|request|fetch|http|navigate|browse|share|exec|run|command)'})], 'ask', 'this session read untrusted content and private data; it could be leaking one through the other'),
        ('trifecta-canary', '*', [('session.label.untrusted-input', {'equals': True}), ('session.label.canary-read', {'equals': True}), ('tool_name', {'regex': '(?i)(send|post|publish|upload|email|mail|message|comment|reply|create|update|push|webhook|request|fetch|http|navigate|browse|share|exec|run|command)'})], 'ask', 'this session read untrusted content and a planted credential; it could be leaking one through the other'),
        ('egress-after-untrusted', '*', [('session.label.untrusted-input', {'equals': True}), ('tool_name', {'regex': '(?i)(send|post|publish|upload|email|mail|message|comment|reply|create|update|push|webhook|request|fetch|http|navigate|browse|share)'})], 'ask', 'this session has read untrusted content; anything that can send data out now needs a human'),
        ('shell-egress-after-untrusted', '*', [('session.label.untrusted-input', {'equals': True}), (SHELL, {'regex': r"""(?i)\b(curl|wget|nc|ncat|ssh|scp|rsync|ftp|sftp|telnet|Invoke-WebRequest|iwr)\b"""})], 'ask', 'this session has read untrusted content; network commands now need a human'),
    ],
}

PACKS['read-only'] = {
    "rules": [
        ('sql-write', '*', [(SQL, {'regex': r"""(?i)\b(insert|update|delete|merge|upsert|replace|drop|truncate|alter|create|grant|revoke|copy)\b"""})], 'deny', 'read-only pack: this SQL writes'),
        ('annotated-read-only', '*', [('annotations.read_only', {'equals': True})], 'allow', 'the server marks this tool as read-only'),
        ('read-verbs', '*', [('tool_name', {'regex': '(?i)^(get|list|read|search|find|fetch|show|describe|view|query|stat|lookup|count|head|tail|diff|status|inspect|explain|check|validate|resolve|download|browse|directory_tree|tree)([_-]|$)'})], 'allow', "the tool's name says it only reads"),
        ('everything-else', '*', [], 'deny', 'read-only pack: this agent may look, not touch'),
    ],
}

PACKS['shell-strict'] = {
    "rules": [
        ('reverse-shell', '*', [(SHELL, {'regex': r"""(?i)(\bnc(at)?\b[^;&|]*\s-[a-z]*e\s|/dev/(tcp|udp)/|\bbash\s+-i\s*>&|\bsocat\b[^;&|]*\bexec:|\bmkfifo\b[^;&]*\|\s*(nc|ncat)\b|\bpython[23]?\s+-c\s+["'][^"']*socket[^"']*connect)"""})], 'deny', 'this opens a reverse shell'),
        ('decode-and-run', '*', [(SHELL, {'regex': r"""(?i)(base64\s+(-d|--decode|-D)|xxd\s+-r|openssl\s+(enc\s+)?-d)[^;&]*\|\s*(sudo\s+)?(ba|z|k|da)?sh\b|\beval\s+["'$(]"""})], 'deny', "running decoded or eval'd text hides what is being executed"),
        ('power', '*', [(SHELL, {'shell_regex': r"""(?i)(^|[;&|]\s*|\s)(shutdown|reboot|halt|poweroff|init\s+[06])(\s|;|&|$)"""})], 'deny', 'an agent does not turn the machine off'),
        ('sudo', '*', [(SHELL, {'shell_regex': r"""(^|[;&|(]\s*|\s)(sudo|doas|pkexec)\s"""})], 'ask', 'this runs with root privileges'),
        ('system-packages', '*', [(SHELL, {'shell_regex': r"""(?i)\b(apt(-get)?\s+(install|remove|purge)|yum\s+(install|remove)|dnf\s+(install|remove)|apk\s+add|pacman\s+-S|brew\s+(install|uninstall)|npm\s+(i|install|uninstall)\s+(-g|--global)|snap\s+install|choco\s+install|winget\s+install)\b"""})], 'ask', 'this installs or removes software on the machine'),
        ('persistence', '*', [(SHELL, {'shell_regex': r"""(?i)(>>?\s*["']?(~|\$HOME|/home/[^/\s]+|/root)?/?\.(bashrc|zshrc|profile|bash_profile|zprofile|config/fish/config\.fish)\b|\bcrontab\b|\bsystemctl\s+(enable|start|daemon-reload)|\blaunchctl\s+(load|bootstrap)|/etc/(cron|systemd|init\.d|rc\.local)|authorized_keys)"""})], 'ask', 'this makes something run again later, or lets someone back in'),
    ],
}

PACKS["secrets"] = {
    "labels": [("private-data", "*", [("args.{path,paths,file,files,file_path,filePath,filename}", {"regex": r"(?i)(^|[/\\])\.env(\.[\w-]+)?$"})])],
    "rules": [
        (
            "key-material", "*",
            [("args.{path,paths,file,files,file_path,filePath,filename,command,cmd}", {"regex": r"(?i)(\.ssh/id_(rsa|dsa|ecdsa|ed25519)([^.\w]|$)|\.aws/credentials|\.netrc\b|\.gnupg/|\.pgpass\b|\.npmrc\b|\.docker/config\.json|\.kube/config|\.git-credentials)"})],
            "deny", "this is key material; an agent has no business reading it",
        ),
    ],
}
