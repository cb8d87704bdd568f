"""The substrings that mark framework use."""

QUEUE_CONSUMERS = (
    ("@celery.task", "celery"), ("@shared_task", "celery"), ("@dramatiq.actor", "dramatiq"), ("new Worker(", "bullmq"), ("BullModule", "bullmq"),
    ("include Sidekiq::Worker", "sidekiq"), ("include Sidekiq::Job", "sidekiq"), ("use Oban.Worker", "oban"), ("use Oban.Pro.Worker", "oban"),
    ("nc.subscribe", "nats"), ("channel.consume", "rabbitmq"), ("KafkaConsumer", "kafka"), ("consumer.subscribe", "kafka"),
)
QUEUE_PRODUCERS = (
    (".delay(", "celery"), (".apply_async(", "celery"), (".send(", "dramatiq"), ("queue.add(", "bullmq"), ("new Queue(", "bullmq"),
    ("perform_async", "sidekiq"), ("perform_in", "sidekiq"), ("Oban.insert", "oban"), ("nc.publish", "nats"), ("channel.publish", "rabbitmq"),
    ("channel.basic_publish", "rabbitmq"), ("producer.send", "kafka"), ("producer.produce", "kafka"),
)
SOCKET_HANDLERS = (
    'ws.on("connection"', "ws.on('connection'", "@WebSocketGateway", "WebSocketServer", "websocket.Upgrader", "gorilla/websocket", 'channel "',
    "channel '", 'socket "', "Phoenix.Channel", "ActionCable", "ws.handleUpgrade",
)
SOCKET_CLIENTS = ("new WebSocket(", "useWebSocket(", "io(", "io.connect(", "socket.io-client", "ws.connect(", "WebSocketSubject(", "connectWebSocket(")
#: With whether a literal after it names the event.
EVENT_EMITTERS = (
    (".emit(", True), (".dispatch(", True), ("Subject.next(", True), ("EventBridge.putEvents", False), ("eventBridge.putEvents", False),
    ("publish(", True), (".trigger(", True), ("dispatchEvent(", True),
)
EVENT_HANDLERS = (
    (".on(", True), (".addEventListener(", True), (".subscribe(", True), ("@EventPattern(", True), ("@OnEvent(", True), ("handle_event", False),
    (".addListener(", True),
)
GRAPHQL_OPERATIONS = ("useQuery(", "useMutation(", "useSubscription(", "useLazyQuery(", "client.query(", "client.mutate(", "client.subscribe(", "graphql-request", "request(")
GRAPHQL_RESOLVERS = (
    "@Query(", "@Mutation(", "@Subscription(", "@Resolver(", "@ResolveField(", "type Query {", "type Mutation {", "type Subscription {",
    "@strawberry.type", "@strawberry.mutation", "ObjectType):", "graphene.ObjectType",
)
GRPC_CLIENTS = ("NewClient(", "Client(", "Stub(", "ServiceClient(")
CLI_INVOCATIONS = (
    "exec.Command(", "exec.CommandContext(", "child_process.spawn(", "child_process.exec(", "child_process.execFile(", "execSync(", "spawnSync(",
    "subprocess.run(", "subprocess.Popen(", "subprocess.call(", "os.system(", "Process.Start(", "std::process::Command::new(", "Command::new(",
    "system(",
)
DATA_SOURCES = (
    ("pg.", 23, "postgres"), ("psycopg", 23, "postgres"), ("mysql.", 23, "mysql"), ("sqlite", 23, "sqlite"), ("MongoClient", 23, "mongodb"),
    ("mongoose.", 23, "mongodb"), ("Prisma", 23, "prisma"), ("TypeORM", 23, "typeorm"), ("Sequelize", 23, "sequelize"),
    ("sqlalchemy", 23, "sqlalchemy"), ("diesel::", 23, "diesel"), ("sqlx::", 23, "sqlx"), ("ActiveRecord", 23, "activerecord"),
    ("Ecto.Repo", 23, "ecto"), ("gorm.", 23, "gorm"), ("database/sql", 23, "database_sql"), ("Redis", 24, "redis"), ("redis.", 24, "redis"),
    ("Memcached", 24, "memcached"), ("memcache", 24, "memcached"), ("S3Client", 25, "s3"), ("boto3.client('s3')", 25, "s3"),
    ("BlobServiceClient", 25, "azure_blob"), ("google-cloud-storage", 25, "gcs"), ("@google-cloud/storage", 25, "gcs"),
    ("Elasticsearch", 26, "elasticsearch"), ("OpenSearch", 26, "opensearch"), ("Algolia", 26, "algolia"), ("Meilisearch", 26, "meilisearch"),
    ("Typesense", 26, "typesense"), ("SendGrid", 27, "sendgrid"), ("Mailgun", 27, "mailgun"), ("nodemailer", 27, "nodemailer"), ("smtplib", 27, "smtp"),
    ("@aws-sdk/client-ses", 27, "ses"), ("postmark", 27, "postmark"), ("Resend", 27, "resend"),
)
